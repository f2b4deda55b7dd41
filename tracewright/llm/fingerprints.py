"""Document fingerprints from prefix polynomial hashes.

Arrays of the polynomial hashes of a text's prefixes, modulo two primes, give the hash
of any span by one subtraction and one product.  Two spans are compared at once, and the
longest common extension of two places is found by binary search over its length.

A fingerprint is the hash of the whole text, then the ``KEPT`` smallest mixed hashes of
its spans of ``SPAN`` code points (of the whole text, if shorter), in hexadecimal.  Equal
texts have equal fingerprints; the empty text's has no kept values.

The likeness of two fingerprints is 1 when they are equal.  Else spans that both keep, and
the beginnings, are places that the texts may have in common; from each the longest common
extension is taken both ways, by binary search over the prefix hashes.  Likeness is the
share of both texts' code points that such extensions of ``SPAN`` and more cover.

Null text counts as empty.  An empty table has an empty result; repeated rows are followed
by each other; very long texts take memory in proportion to their length, one at a time.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import U64, mix64, n_partitions

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525003)
SPAN = 24
KEPT = 48
#: Rows of a range of ids, and how many ranges there may be: a row for each comes to the driver.
RANGE_ROWS = 20000
MOST_RANGES = 1 << 15
SALT = U64(SPAN * 0x9E3779B97F4A7C15 % 2**64)


class ModularPowers:
    def __init__(self, prime: int, base: int):
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, dtype=U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:  # doubling: the second half is the first times one power
            size = U64(self.prime)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, len(self.up), self.prime)) % size])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, len(self.down), self.prime)) % size])
        return self.up[:n], self.down[:n]


POWERS = [ModularPowers(p, b) for p, b in zip(PRIMES, BASES, strict=True)]


class PrefixHashes:
    """Hashes of the prefixes of one text, in code points."""

    def __init__(self, text: str):
        self.text = text
        self.codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(U64) + U64(1)
        self.n = len(self.codes)
        self.sums = []
        for powers in POWERS:
            up, _ = powers.to(self.n + 1)
            sums = np.zeros(self.n + 1, dtype=U64)
            np.cumsum(self.codes * up[: self.n] % U64(powers.prime), out=sums[1:])
            self.sums.append(sums % U64(powers.prime))

    def followed(self, other: PrefixHashes, stays: int, taken: int, text: str) -> PrefixHashes:
        """The hashes of the first ``stays`` code points here and the first ``taken`` there, one after the other."""
        out = object.__new__(PrefixHashes)
        out.text, out.n, out.sums = text, stays + taken, []
        for powers, a, b in zip(POWERS, self.sums, other.sums, strict=True):
            prime = U64(powers.prime)
            step = powers.to(stays + 1)[0][stays]
            out.sums.append(np.concatenate([a[: stays + 1], (b[1 : taken + 1] * step + a[stays]) % prime]))
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of the spans [start, end), equal for equal spans of any texts."""
        both = []
        for powers, sums in zip(POWERS, self.sums, strict=True):
            _, down = powers.to(self.n + 1)
            prime = U64(powers.prime)
            both.append((sums[ends] + prime - sums[starts]) % prime * down[starts] % prime)
        return mix64((both[0] << U64(32) | both[1]) + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def residues(self, start: int, end: int) -> tuple[int, int]:
        """The unmixed hashes of one span."""
        a, b = ((int(sums[end]) - int(sums[start])) * int(powers.to(self.n + 1)[1][start]) % powers.prime for powers, sums in zip(POWERS, self.sums, strict=True))
        return a, b

    def windows(self) -> np.ndarray:
        """Hashes of all spans of SPAN code points, by start."""
        starts = slice(0, max(0, self.n - SPAN + 1))
        both = []
        for powers, sums in zip(POWERS, self.sums, strict=True):
            _, down = powers.to(self.n + 1)
            prime = U64(powers.prime)
            both.append((sums[SPAN:] + prime - sums[starts]) % prime * down[starts] % prime if self.n >= SPAN else np.zeros(0, dtype=U64))
        return mix64((both[0] << U64(32) | both[1]) + SALT)

    def equal(self, i: int, j: int, size: int, other: PrefixHashes | None = None) -> bool:
        """Whether the spans of ``size`` code points at i here and at j there are equal."""
        return self.residues(i, i + size) == (other or self).residues(j, j + size)

    def extension(self, i: int, j: int, other: PrefixHashes | None = None) -> int:
        """The length of the longest common extension of place i here and place j there."""
        low, high = 0, min(self.n - i, (other or self).n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, j, middle, other):
                low = middle
            else:
                high = middle - 1
        return low

    def extension_back(self, i: int, j: int, other: PrefixHashes | None = None) -> int:
        """The length of what the texts before place i here and place j there end with in common."""
        low, high = 0, min(i, j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i - middle, j - middle, middle, other):
                low = middle
            else:
                high = middle - 1
        return low


def kept(values: np.ndarray) -> np.ndarray:
    """The KEPT smallest distinct values, in order."""
    if len(values) > 8 * KEPT:
        few = np.unique(np.partition(values, 4 * KEPT)[: 4 * KEPT])
        if len(few) >= KEPT:
            return few[:KEPT]
    return np.unique(values)[:KEPT]


def written(whole: int, values: np.ndarray) -> str:
    return f"{whole:016x}" + "".join(f"{v:016x}" for v in values.tolist())


def fingerprint(text: str | None) -> str:
    hashes = PrefixHashes(text or "")
    return written(*sketch(hashes, hashes.windows()))


def sketch(hashes: PrefixHashes, windows: np.ndarray) -> tuple[int, np.ndarray]:
    whole = hashes.span(0, hashes.n)
    return whole, kept(windows) if len(windows) else np.array([whole][: hashes.n], dtype=U64)


def first_places(windows: np.ndarray, values: np.ndarray) -> dict[int, int]:
    """Where each of some window hashes stands first."""
    at = np.flatnonzero(np.isin(windows, values))
    return {int(windows[i]): int(i) for i in at[::-1]}


class Fingerprinted:
    """A text with its hashes, spans and sketch."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id = doc_id
        self.hashes = PrefixHashes(text or "")
        self.windows = self.hashes.windows()
        self.sketch = sketch(self.hashes, self.windows)

    def likeness(self, other: Fingerprinted) -> float:
        """From 0 to 1: the share of both texts that longest common extensions of shared places cover."""
        if self.sketch[0] == other.sketch[0]:
            return 1.0
        a, b = self.hashes, other.hashes
        whole = min(a.n, b.n)
        runs = [(0, 0, first)] if (first := a.extension(0, 0, b)) >= min(SPAN, whole) > 0 else []
        shared = np.intersect1d(self.sketch[1], other.sketch[1])
        if len(shared) and len(self.windows) and len(other.windows):
            there = first_places(other.windows, shared)
            for value, i in sorted(first_places(self.windows, shared).items(), key=lambda x: x[1]):
                j = there[value]
                if any(x <= i < x + n and i - x == j - y for x, y, n in runs):
                    continue
                back = a.extension_back(i, j, b)
                runs.append((i - back, j - back, back + a.extension(i, j, b)))
        ours, theirs = (covered([(r[k], r[k] + r[2]) for r in runs]) for k in (0, 1))
        return (ours + theirs) / (a.n + b.n)

    def row(self, following: Fingerprinted) -> tuple:
        """The columns of ``edited_by_next``."""
        n = self.hashes.n
        taken = min(n // 3, following.hashes.n)
        stays = n - n // 3
        text = self.hashes.text[:stays] + following.hashes.text[:taken]
        edited = self.edited(following, stays, taken, text)
        sha = hashlib.sha256(text.encode()).hexdigest()
        return self.doc_id, n, sha, written(*self.sketch), written(*edited.sketch), self.likeness(edited), self.likeness(following)

    def edited(self, following: Fingerprinted, stays: int, taken: int, text: str) -> Fingerprinted:
        """The edited text; what it has of either text keeps its hashes."""
        if stays + taken < SPAN:
            return Fingerprinted(self.doc_id, text)
        out = object.__new__(Fingerprinted)
        out.doc_id, out.hashes = self.doc_id, self.hashes.followed(following.hashes, stays, taken, text)
        seam = PrefixHashes(text[max(0, stays - SPAN + 1) : stays + SPAN - 1])
        out.windows = np.concatenate([self.windows[: max(0, stays - SPAN + 1)], seam.windows(), following.windows[: max(0, taken - SPAN + 1)]])
        out.sketch = out.hashes.span(0, out.hashes.n), kept(out.windows)
        return out


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places some spans cover together."""
    total = end = 0
    for first, last in sorted(spans):
        total += max(0, last - max(first, end))
        end = max(end, last)
    return total


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
NULLS = -1


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text."""
    return df.withColumn(out, F.pandas_udf(lambda s: s.map(lambda t: fingerprint(t), na_action=None), "string")(text))


def edited_by_next(docs: DataFrame) -> DataFrame:
    """Of each row: its fingerprint, that of its text with the last third replaced by the
    next document's beginning, and its likeness to that and to the next document.

    The next document is the one after it by descending doc_id, null ids last; rows of
    one doc_id follow each other by text; the first follows the last.  Rows go to ranges of
    ids, found from quantiles, by one shuffle; the first row of each range travels to the
    range before it as well, so each range is judged by itself in one pass.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = min(MOST_RANGES, max(4 * n_partitions(spark), math.ceil(docs.count() / RANGE_ROWS)))
    marks = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = np.unique(np.array(marks, dtype=np.int64))

    def place(ids: pd.Series) -> np.ndarray:
        """Ranges by descending id; NULLS for null."""
        known = ids.notna()
        found = np.full(len(ids), NULLS, dtype=np.int64)
        found[known] = len(bounds) - np.searchsorted(bounds, ids[known].astype("int64"))
        return found

    ranged = F.pandas_udf(lambda ids: pd.Series(place(ids)), "long")
    tops = docs.select("doc_id", ranged("doc_id").alias("at")).groupBy("at").agg(F.max("doc_id").alias("top")).collect()  # a row for each range
    order = sorted(tops, key=lambda r: (r["at"] == NULLS, r["at"]))
    before = {r["top"]: order[i - 1]["at"] for i, r in enumerate(order)}

    def also(ids: pd.Series) -> pd.Series:
        return pd.Series([before.get(None if pd.isna(i) else int(i)) for i in ids], dtype="Int64")

    led = F.pandas_udf(also, "long")
    goes = F.array(F.struct(ranged("doc_id").alias("at"), F.lit(0).alias("guest")), F.struct(led("doc_id").alias("at"), F.lit(1).alias("guest")))
    dealt = docs.withColumn("goes", F.explode(goes)).where("goes.at IS NOT NULL").select("goes.at", "goes.guest", "doc_id", "text")
    sorted_rows = dealt.repartition(n, "at").sortWithinPartitions("at", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, Fingerprinted] | None = None
        for batch in batches:
            rows = []
            for at, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guest and (last is None or last[0] != at):
                    continue  # only the first guest of a range counts
                row = Fingerprinted(doc_id, text)
                if last is not None and last[0] == at:
                    rows.append(last[1].row(row))
                last = None if guest else (at, row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    return sorted_rows.mapInArrow(run, SCHEMA)
