"""Token counts by prefix dynamic programming.

For a byte-pair model, the segmentation of a prefix of a marked word is the
segmentation of a shorter prefix and one more piece: the only piece that ends there
and stands unchanged beside the shorter prefix's last piece.  One pass over a word
so gives the exact count of tokens at every prefix, at a bounded number of pieces a
character.  Marked words (see ``sentencepiece_codec``) are independent, so the counts
of a text are the running totals over its words, plus the counts in the word where a
prefix ends: enough to answer, for any prefix and any budget, how many tokens there
are, without encoding again.  Each task keeps a bounded table of distinct words.

Pieces that merge as soon as they arise, though a part of theirs ranks behind them
(runs of markers), are checked against the library: a word that
ends in another count takes the library's counts for all its prefixes.

Null text counts as empty: 0 tokens at its only prefix.  Input columns stay; an
output column replaces one of the same name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewright.llm.common import modest_batches
from tracewright.llm.sentencepiece_codec import MARK, MARKED_WORD, MAX_KEPT_CHARS, check_separable, extended, model_spec, with_column

MAX_WORDS = 1 << 20
MAX_PAIRS = 1 << 19
MAX_BLOCK_CHARS = 1 << 22


class Pairs(dict):
    """Whether two pieces stay as they are side by side, for the pairs met so far."""

    def __init__(self, judge):
        super().__init__()
        self.judge = judge

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= MAX_PAIRS:
            self.clear()
        self[pair] = found = self.judge(*pair)
        return found


class PrefixCounter(dict):
    """Counts at every prefix of each distinct marked word."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        spec = model_spec(path)
        check_separable(spec)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = spec.trainer_spec.byte_fallback
        self.score = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.longest = max(map(len, self.score))
        #: Of each piece that its own text is segmented into: its place in the order of merging, and the two parts merged last.
        self.order: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        #: Pieces merged at once when a part arises that ought to merge later: their neighbours are judged by segmenting.
        self.sudden: set[str] = set()
        place = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        for piece, score in self.score.items():
            parts = self.merged(piece, until=2)
            if len(piece) > 1 and (len(parts) != 2 or self.merged(piece) != [piece]):
                continue
            self.order[piece] = place[score] if len(piece) > 1 else -1
            if len(piece) > 1:
                self.halves[piece] = (parts[0], parts[1])
        for piece, halves in self.halves.items():
            if any(self.order.get(h, -1) >= self.order[piece] or h in self.sudden for h in halves):
                self.sudden.add(piece)
        self.stays = Pairs(self.beside)
        self.latest: tuple[str, list[int], list[str]] = ("", [0], [""])

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The segmentation of a short text: the best pair merges first, the left one of equals."""
        parts, score = list(text), self.score
        while len(parts) > until:
            best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def beside(self, left: str, right: str) -> bool:
        """Whether both pieces stay as they are side by side: undoing their merges, latest first, no merge across comes earlier."""
        if left in self.sudden or right in self.sudden:
            return self.merged(left + right) == [left, right]
        order, halves = self.order, self.halves
        before_left = before_right = 1 << 60
        at_left, at_right = order.get(left, -1), order.get(right, -1)
        while True:
            across = order.get(left + right)
            if across is not None and across < before_left and across <= before_right:
                return False
            if at_left > at_right:
                before_left, left = at_left, halves[left][1]
                at_left = order.get(left, -1)
            elif at_right >= 0:
                before_right, right = at_right, halves[right][0]
                at_right = order.get(right, -1)
            else:
                return True

    def cost(self, piece: str) -> int:
        return len(piece.encode()) if self.fallback and piece not in self.score else 1

    def prefixes(self, word: str) -> list[int]:
        """Counts at prefixes of 0, 1, .. characters of a word that starts with a marker.

        Prefixes that it shares with the word asked for before are taken over.
        """
        word, order, stays, longest = word.replace(" ", MARK), self.order, self.stays, self.longest
        done, counts, last = self.latest
        same = 1
        for a, b in zip(done, word, strict=False):
            if a != b:
                break
            same += 1
        counts, last = counts[:same], last[:same]
        for end in range(same, len(word) + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = word[start:end]
                if (piece in order or end - start == 1) and (start == 0 or stays[last[start], piece]):
                    counts.append(counts[start] + (1 if piece in order else self.cost(piece)))
                    last.append(piece)
                    break
        self.latest = word, counts, last
        if not self.sudden.isdisjoint(last) and counts[-1] != (len(self.library.encode(word[1:])) or 1):
            return [0, *(len(self.library.encode(word[1:i])) or 1 for i in range(1, len(word) + 1))]
        return counts

    def __missing__(self, word: str) -> Sequence[int]:
        counts: Sequence[int] = self.prefixes(word)
        if counts[-1] < 256 and len(word) < 256:
            counts = bytes(counts)  # a tenth of a list's memory
        if len(word) <= MAX_KEPT_CHARS:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = counts
        return counts


    def totals(self, texts: list[str | None]) -> list[int]:
        """The counts of whole texts; new words are met in order, which shares their prefixes."""
        parts = [MARKED_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        for word in sorted(set().union(*parts).difference(self)):
            self[word]
        return [sum([self[w][-1] for w in p]) for p in parts]


def blocks(texts: list[str | None], most: int = MAX_BLOCK_CHARS) -> Iterator[list[str | None]]:
    """Consecutive runs of texts of about ``most`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    yield run


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


class TextPrefixes:
    """The exact token counts of one text's prefixes."""

    def __init__(self, words: PrefixCounter, text: str | None):
        self.text, self.words = text or "", words
        self.parts = MARKED_WORD.findall(" " + self.text.replace(MARK, " ")) if self.text else []
        self.starts = np.cumsum([0, *map(len, self.parts)])
        self.totals = np.cumsum([0, *(words[w][-1] for w in self.parts)])

    @property
    def total(self) -> int:
        return int(self.totals[-1])

    def at(self, n_chars: int) -> int:
        """Tokens of the first n_chars characters."""
        if n_chars <= 0 or not self.parts:
            return 0
        place = min(n_chars, len(self.text)) + 1  # with the marker that the library puts first
        k = min(bisect_right(self.starts, place) - 1, len(self.parts) - 1)
        return int(self.totals[k]) + self.words[self.parts[k]][place - int(self.starts[k])]

    def fitting(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        if not self.parts or self.total <= budget:
            return len(self.text)
        for k in range(min(bisect_right(self.totals, budget) - 1, len(self.parts) - 1), -1, -1):
            counts = self.words[self.parts[k]]
            for i in range(len(counts) - 1, 0, -1):
                if self.totals[k] + counts[i] <= budget:
                    return max(0, int(self.starts[k]) + i - 1)
        return 0


def count_tokens(df: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the token count of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(model)
        for batch in batches:
            totals = [n for block in blocks(batch.column(text).to_pylist()) for n in words.totals(block)]
            yield with_column(batch, out, pa.array(totals, pa.int64()))

    modest_batches(df.sparkSession)
    return df.mapInArrow(run, extended(df, out, T.LongType()))


def prefix_counts(df: DataFrame, model: str, text: str = "text", out: str = "prefix_counts") -> DataFrame:
    """Adds the counts at prefixes of 0, 1, .. characters of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(model)
        for batch in batches:
            rows = []
            for t in batch.column(text).to_pylist():
                p = TextPrefixes(words, t)
                flat = [int(p.totals[k]) + c for k, w in enumerate(p.parts) for c in words[w][1:]]
                rows.append([0, *flat[1:]])
            yield with_column(batch, out, pa.array(rows, pa.list_(pa.int32())))

    return df.mapInArrow(run, extended(df, out, T.ArrayType(T.IntegerType())))


def truncate(df: DataFrame, model: str, budget: int, text: str = "text", out: str = "truncated") -> DataFrame:
    """Adds the longest prefix of each text that has at most ``budget`` tokens (null text: "")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(model)
        for batch in batches:
            cut = [(t or "")[: TextPrefixes(words, t).fitting(budget)] for t in batch.column(text).to_pylist()]
            yield with_column(batch, out, pa.array(cut, pa.string()))

    return df.mapInArrow(run, extended(df, out, T.StringType()))
