import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tracewright.llm import entries, sentencepiece_codec, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", " ", "   ", "a  b ", "▁a ▁▁", "\n\n x\t\r\n", "<s>a</s><unk>", "<0x0A>", "﻿a\x00b", "👩‍👩‍👧 né ", "x" * 3000, " " * 50 + "y", "日本語 テスト", "a" + " " * 17 + "b" + "​"]


def randoms(n=400):
    rng = random.Random(3)
    alphabet = "aabeinorst  \n▁éß漢👍.,<>0-"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_codec_is_the_library():
    codec = sentencepiece_codec.Codec(MODEL)
    import numpy as np

    for text in ODD + randoms():
        ids = np.frombuffer(codec.packed(text), dtype="<i4")
        assert ids.tolist() == LIBRARY.encode(text), text
        assert codec.decode(ids) == LIBRARY.decode(ids.tolist())


def test_decode_any_ids():
    codec = sentencepiece_codec.Codec(MODEL)
    import numpy as np

    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randint(1, 12))]
        assert codec.decode(np.array(ids)) == LIBRARY.decode(ids), ids


def test_prefix_counts_are_the_librarys():
    words = token_counts.PrefixCounter(MODEL)
    for text in [t for t in ODD if len(t) < 100] + randoms(150):
        p = token_counts.TextPrefixes(words, text)
        every = [len(LIBRARY.encode(text[:i])) for i in range(len(text) + 1)]
        assert [p.at(i) for i in range(len(text) + 1)] == every, text
        for budget in (0, 1, 3, 7, 1000):
            assert p.fitting(budget) == max(i for i, n in enumerate(every) if n <= budget)


@pytest.fixture
def rows(spark, tmp_path):
    texts = [None, *ODD, "same text", "same text"]
    data = [(i if i != 3 else None, t, "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    return texts, str(tmp_path)


def test_queries(spark, rows):
    texts, path = rows
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entries.op1_sentencepiece(spark, path).collect())
    want = sorted((len(ids := LIBRARY.encode(t or "")), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))) for t in texts)
    assert got == want
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in entries.op10_token_counts(spark, path).collect())
    assert got == sorted((len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 4096) for t in texts)


def test_general_interface(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    out = token_counts.truncate(token_counts.prefix_counts(df, MODEL), MODEL, 2).orderBy("doc_id").collect()
    assert out[0].prefix_counts == [len(LIBRARY.encode("one two"[:i])) for i in range(8)]
    assert (out[1].prefix_counts, out[1].truncated) == ([0], "")
    assert sentencepiece_codec.encode(df.limit(0), MODEL).collect() == []
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(df, MODEL), MODEL).orderBy("doc_id").collect()
    assert [r.decoded for r in coded] == ["one two", ""]
    at_once = sentencepiece_codec.coded(df, MODEL).orderBy("doc_id")
    assert at_once.columns == ["doc_id", "ids", "decoded"]
    assert at_once.collect() == [(r.doc_id, r.ids, r.decoded) for r in coded]


def test_count_tokens(spark):
    texts = [None, "", "one two", "x" * 5000] + [f"row {i}" for i in range(1500)]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, body string, n string")
    out = token_counts.count_tokens(df, MODEL, text="body", out="n").orderBy("doc_id")
    assert out.columns == ["doc_id", "body", "n"]
    assert [r.n for r in out.collect()] == [len(LIBRARY.encode(t or "")) for t in texts]
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
