"""SentencePiece encoding and decoding over a table of distinct marked words.

In a model whose pieces never hold a whitespace marker after another character,
no merge can cross the place where a marker follows a word.  A text, marked as
the library marks it, therefore falls into marked words that are segmented
independently of each other.  Each task keeps a table from marked word to packed
ids: a word is segmented once by the library when first met, and the ids of
a text are joined from the table in order of position.  The table is emptied when
it reaches ``MAX_WORDS`` and very long words are not kept, so memory is bounded;
neither changes a result.  There is no shuffle.

Null text counts as empty; an empty text has no ids and decodes to "".  Repeated
rows give repeated rows.  All columns of the input stay; an output column replaces
one of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewright.llm.common import lean, modest_batches

MARK = "▁"
MAX_WORDS = 1 << 17
MAX_KEPT_CHARS = 64
MARKED_WORD = re.compile(" +[^ ]*")


class NotSeparable(ValueError):
    """The model's pieces can cross whitespace markers."""


def model_spec(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    return spec


def check_separable(spec) -> None:
    """Raises unless marked words can be segmented one by one with the same result."""
    norm, trainer = spec.normalizer_spec, spec.trainer_spec
    plain = len(norm.precompiled_charsmap) == 0 and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
    if not plain or trainer.treat_whitespace_as_suffix:
        raise NotSeparable("the model rewrites text or white space before it segments")
    crossing = re.compile(f"[^{MARK}]{MARK}")
    if any(crossing.search(p.piece) for p in spec.pieces) or any(p.type == 4 for p in spec.pieces):
        raise NotSeparable("a piece reaches beyond a whitespace marker")


class WordTable(dict):
    """Packed int32 ids of each distinct marked word (with its leading spaces)."""

    def __init__(self, processor):
        super().__init__()
        self.encode = processor.encode
        self[" "] = self.alone = np.asarray([processor.piece_to_id(MARK)], dtype="<i4").tobytes()

    def __missing__(self, word: str) -> bytes:
        packed = np.asarray(self.encode(word[1:]), dtype="<i4").tobytes()  # the library puts the first marker back
        if len(word) <= MAX_KEPT_CHARS:
            if len(self) >= MAX_WORDS:
                self.clear()
                self[" "] = self.alone
            self[word] = packed
        return packed


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        spec = model_spec(path)
        check_separable(spec)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words = WordTable(self.processor)
        self.pieces = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        self.plain = np.array([p.type in (1, 6) for p in spec.pieces])
        self.opens = np.array([p.type == 1 and p.piece.startswith(MARK) for p in spec.pieces])

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian int32."""
        if not text:
            return b""
        words = self.words
        return b"".join([words[w] for w in MARKED_WORD.findall(" " + text.replace(MARK, " "))])

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) == 0:
            return ""
        if self.opens[ids[0]] and self.plain[ids].all():
            pieces = self.pieces
            try:
                return b"".join([pieces[i] for i in ids.tolist()]).decode()[1:]
            except UnicodeDecodeError:
                pass  # ids that no text has: as the library does
        return self.processor.decode(ids.tolist())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per Python worker and model."""
    return Codec(path)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, f in enumerate(batch.schema.names) if f != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [values], names=[batch.schema.names[i] for i in kept] + [name])


def extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encoded(one: Codec, texts: pa.Array) -> pa.ListArray:
    parts = [one.packed(t) for t in texts.to_pylist()]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def decoded_texts(one: Codec, ids: pa.ListArray) -> pa.Array:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array([one.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as the library gives them, without begin or end ids."""
    modest_batches(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            yield with_column(batch, ids, encoded(one, batch.column(text)))

    return df.mapInArrow(run, extended(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that the library's decode makes of each list of ids (null: "")."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            yield with_column(batch, decoded, decoded_texts(one, batch.column(ids)))

    return df.mapInArrow(run, extended(df, decoded, T.StringType()))


def coded(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Puts each whole text's ids and what they decode to in the text's place, in one pass over it."""
    modest_batches(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            found = encoded(one, batch.column(text))
            rest = batch.select([n for n in batch.schema.names if n != text])
            yield with_column(with_column(rest, ids, found), decoded, decoded_texts(one, found))

    fields = [f for f in df.schema.fields if f.name not in (text, ids, decoded)]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]))
