"""Removal of byte strings that occur more than once, whatever document they stand in.

A Burrows-Wheeler transform of one block of text, extended backward breadth first, gives
the common prefixes of neighbouring suffixes by increasing value up to the least length
(``bwt_repeats``).  It needs all the text in one place, so for corpora the same
strings are found as follows (the README has the reasons and figures).

1. Each string of ``length`` bytes has an anchor: the leftmost of its grams of ``GRAM``
   bytes with the smallest hash.  Equal strings have their anchors at equal places, and
   a text has about two anchors for each ``length`` bytes.
2. Anchors' grams are counted; those that occur once belong to no repeated string.
3. Each other anchor gets the bytes around it that strings with it can hold.  Equal grams
   meet, and for each offset the hashes of the strings at that offset are compared: equal
   ones stand for strings that start at different places.  Groups of up to ``LARGE``
   anchors are compared in memory.
4. Larger groups never meet in a task.  Their offsets are cut into ``PARTS`` ranges.  What
   all strings of a range hold in common is counted, and ranges where it is single are
   dropped; what they span together is counted, and where it occurs again all of
   them do.  Only ranges in between are cut again, down to single strings; each repeated
   span is represented there once.
5. The strings' spans are joined for each text.

Copies of a whole text are one node in all this; a text of at least ``length`` bytes that
stands in several rows is removed whole.  Strings and texts are equal where their hashes of 64 and
128 bits are; the bytes themselves are not compared again.

Null text counts as empty.  Texts shorter than ``length`` lose nothing.  An empty table has an
empty result.  Columns other than doc_id and text are not looked at.  Removal can
cut characters; the cleaned text leaves out bytes that no longer form one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import BYTE_CODES, POWERS, U64, discard, lean, materialize, mix64, modest_batches, n_partitions, prefix_sums, release

LENGTH = 400
GRAM = 32
#: A group's prefix hashes take 6 KB an anchor: 100 MB at most.
LARGE = 1 << 14
PARTS = 4
CHUNK = 2048
#: Offsets whose hashes are compared at once, and anchors whose prefixes are hashed at once.
COLUMNS = 64
BLOCK = 1024


def transform_repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, starts of its strings of ``length`` bytes that occur again, there or in another part.

    By backward extension on the Burrows-Wheeler transform of the parts, each ended by a symbol of its own.
    """
    m = len(parts)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    n = int(sizes.sum()) + m
    text = np.empty(n, dtype=np.int64)
    for i, (p, at) in enumerate(zip(parts, firsts, strict=True)):
        text[at : at + len(p)] = np.frombuffer(p, dtype=np.uint8)
        text[at : at + len(p)] += m
        text[at + len(p)] = i
    order, rank, size = np.argsort(text, kind="stable"), text.copy(), 1
    while True:
        second = np.concatenate([rank[size:], np.full(min(size, n), -1)])[:n]
        order = np.lexsort((second, rank))
        new = np.concatenate([[0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))])
        rank = np.empty_like(new)
        rank[order] = new
        if new[-1] == n - 1 or size > length:
            break  # beyond the length, the order no longer matters
        size *= 2
    transform = text[order - 1]
    where = {int(c): np.flatnonzero(transform == c) for c in np.unique(transform) if c >= m}
    before = {c: int((text < c).sum()) for c in where}
    common = np.full(n + 1, -1)  # of the suffixes at i - 1 and i; -1: at least as long as the values tried
    common[: m + 1] = common[n] = 0  # ends come first and have nothing in common
    low, high = np.array([0]), np.array([n])
    for value in range(length):
        lows, highs = [], []
        for c, at in where.items():
            lo, hi = before[c] + np.searchsorted(at, low), before[c] + np.searchsorted(at, high)
            fresh = (hi > lo) & (common[hi] < 0)
            if value == 0:
                fresh = hi > lo
            _, first = np.unique(hi[fresh], return_index=True)
            lo, hi = lo[fresh][first], hi[fresh][first]
            common[hi] = np.where(common[hi] < 0, value, common[hi])
            lows.append(lo)
            highs.append(hi)
        if value == 0:  # the ends open intervals of their own
            lows.append(np.arange(m))
            highs.append(np.arange(m) + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        if not len(low):
            break
    shared = np.flatnonzero(common[1:n] < 0) + 1
    starts = np.unique(np.concatenate([order[shared], order[shared - 1]]))
    owner = np.searchsorted(firsts, starts, side="right") - 1
    inside = starts - firsts[owner] + length <= sizes[owner]
    return [starts[inside & (owner == i)] - firsts[i] for i in range(m)]


def bwt_repeats(data: bytes, length: int) -> np.ndarray:
    """Starts of the strings of ``length`` bytes that occur again in one text."""
    return transform_repeats([data], length)[0]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, in linear time."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of all anchors of a text."""
    gram = min(GRAM, length)
    if len(data) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    sums = prefix_sums(np.frombuffer(data, dtype=np.uint8))
    _, down = POWERS.to(len(sums))
    n = len(data) - gram + 1
    hashes = mix64((sums[gram:] - sums[:n]) * down[:n])
    keys = (hashes & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    places = np.unique(sliding_least(keys, length - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    return places, hashes[places]


def text_keys() -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def list_array(parts: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("the lists of one batch hold more than 2**31 - 1 values; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, dtype=kind)))


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, h1, h2, sha256, n_bytes and anchors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for t in batch.column("text").to_pylist():
                data = t.encode()
                sizes.append(len(data))
                found.append(anchors(data, length))
            columns = [batch.column(n) for n in ("doc_id", "h1", "h2", "sha256")]
            columns += [pa.array(sizes, pa.int64()), list_array([p for p, _ in found], np.int32), list_array([g.view(np.int64) for _, g in found], np.int64)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "sha256", "n_bytes", "places", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *text_keys(), F.sha2("text", 256).alias("sha256"))
    return rows.mapInArrow(lean(run), "doc_id long, h1 long, h2 long, sha256 string, n_bytes long, places array<int>, grams array<long>")


class Contexts:
    """The bytes around anchors, filled up to equal length, and the hashes of their strings."""

    def __init__(self, around: list[bytes], left: np.ndarray, length: int):
        self.most = length - min(GRAM, length)  # the largest offset of an anchor in a string
        self.length, self.left = length, left
        width = self.most + length
        data = np.zeros((len(around), width), dtype=np.uint8)
        self.right = np.empty(len(around), dtype=np.int64)
        for i, b in enumerate(around):
            at = self.most - int(left[i])
            data[i, at : at + len(b)] = np.frombuffer(b, dtype=np.uint8)
            self.right[i] = len(b) - left[i]
        up, self.down = POWERS.to(width + 1)
        self.sums = np.zeros((len(around), width + 1), dtype=U64)
        for i in range(0, len(around), BLOCK):
            np.cumsum(BYTE_CODES[data[i : i + BLOCK]] * up[None, :width], axis=1, out=self.sums[i : i + BLOCK, 1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A matrix of hashes of spans given by places before and after the anchor."""
        a, b = starts + self.most, ends + self.most
        return mix64((self.sums[:, b] - self.sums[:, a]) * self.down[a][None, :] + (b - a).astype(U64)[None, :] * U64(0x9E3779B97F4A7C15))

    def span(self, rows: np.ndarray, start: int, end: int) -> np.ndarray:
        """The hashes of one span of some anchors."""
        a, b = start + self.most, end + self.most
        return (self.sums[rows, b] - self.sums[rows, a]) * self.down[a]

    def strings(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the strings that start ``offsets`` bytes before the anchor, and which lie in the text."""
        inside = (offsets[None, :] <= self.left[:, None]) & (self.length - offsets[None, :] <= self.right[:, None])
        return self.spans(-offsets, self.length - offsets), inside


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


SPANS = "nid long, first long, last long"


def compare_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram: the spans of strings that equal another anchor's at the same offset."""
    offsets = np.arange(length - min(GRAM, length) + 1)
    held: list[tuple] = []

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        own = Contexts([r[4] for r in rows], np.array([r[3] for r in rows]), length)
        found = np.zeros((len(rows), len(offsets)), dtype=bool)
        for c in range(0, len(offsets), COLUMNS):
            hashes, inside = own.strings(offsets[c : c + COLUMNS])
            hashes[~inside] = mix64(np.flatnonzero(~inside).astype(U64))  # strings that reach out of their text equal none
            order = np.argsort(hashes, axis=0)
            ordered = np.take_along_axis(hashes, order, 0)
            same = ordered[1:] == ordered[:-1]
            marked = np.zeros(hashes.shape, dtype=bool)
            marked[1:] |= same
            marked[:-1] |= same
            np.put_along_axis(found[:, c : c + COLUMNS], order, marked, 0)
            found[:, c : c + COLUMNS] &= inside
        out = [(r[1], r[2] - b, r[2] - a + length) for i, r in enumerate(rows) if found[i].any() for a, b in runs(found[i])]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["nid", "first", "last"])

    for batch in batches:
        held += zip(*(batch.column(n).to_pylist() for n in ("gram", "nid", "place", "left", "around")), strict=True)
        while len(held) >= CHUNK:
            cut = len(held) - 1
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            whole = min(cut, CHUNK)
            while 0 < whole < cut and held[whole - 1][0] == held[whole][0]:
                whole += 1
            if not whole:
                break
            yield compared(held[:whole])
            held = held[whole:]
    if held:
        yield compared(held)


def cut(low, high):
    """Offsets from low to high in at most PARTS ranges of equal width, but for the last."""
    width = F.ceil((high - low + 1) / F.lit(PARTS))
    return F.transform(F.sequence(low, high, width), lambda x: F.struct(x.alias("low"), F.least(x + width - 1, high).alias("high")))


def range_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of each anchor and each of its ranges of offsets: the hash of what all strings there hold in common (core),
    and of what they span together (hull; null if it reaches out of the text)."""
    names = ["nid", "place", "low", "high", "core", "hull"]
    for batch in batches:
        nids, places = (np.array(batch.column(n).to_pylist(), dtype=np.int64) for n in ("nid", "place"))
        own = Contexts(batch.column("around").to_pylist(), np.array(batch.column("left").to_pylist(), dtype=np.int64), length)
        rows: dict[tuple[int, int], list[int]] = {}
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            for r in ranges:
                rows.setdefault((r["low"], r["high"]), []).append(i)
        out: list[list] = [[] for _ in names]
        for (low, high), at in rows.items():
            own_rows = np.array(at)
            left, right = own.left[own_rows], own.right[own_rows]
            own_rows = own_rows[(low <= left) & (length - high <= right)]
            left, right = own.left[own_rows], own.right[own_rows]
            salt = U64(low << 20 | high)
            core = mix64(own.span(own_rows, -low, length - high) ^ salt).view(np.int64)
            hull = mix64(own.span(own_rows, -high, length - low) ^ salt).view(np.int64)
            outside = (high > left) | (length - low > right)
            n = len(own_rows)
            for column, value in zip(out, (nids[own_rows], places[own_rows], np.full(n, low), np.full(n, high), core, np.ma.array(hull, mask=outside)), strict=True):
                column.append(value)
        if out[0]:
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in out[:5]]
            hulls = np.ma.concatenate(out[5])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hulls.data, mask=np.ma.getmaskarray(hulls))], names=names)


def large_groups(large: DataFrame, length: int) -> DataFrame:
    """The spans of anchors whose grams are very frequent, by counting alone."""

    def span(first, last):
        return [(F.col("place") - last).alias("first"), (F.col("place") - first + length).alias("last")]

    most = length - min(GRAM, length)
    members = large.select("nid", "place", "left", "around", cut(F.lit(0).cast("long"), F.lit(most).cast("long")).alias("ranges"))
    spans: DataFrame | None = None
    width = most + 1
    while True:
        width = -(-width // PARTS)
        hashed = materialize(members.mapInArrow(lean(lambda batches: range_hashes(batches, length)), "nid long, place long, low long, high long, core long, hull long"))
        hulls = hashed.where("hull IS NOT NULL").groupBy("hull").agg(F.count("*").alias("n"), F.min(F.struct("nid", "place", "low", "high")).alias("one")).where("n > 1")
        hulls = materialize(hulls.select("hull", "one"))
        again = hashed.join(hulls.select("hull"), "hull", "left_semi").select("nid", *span(F.col("low"), F.col("high")))
        spans = again if spans is None else spans.union(again)
        if width == 1:
            return spans
        cores = hashed.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        unsure = hashed.join(cores, "core", "left_semi").join(hulls.select("hull"), "hull", "left_anti").select("nid", "place", "low", "high")
        unsure = unsure.union(hulls.select("one.*"))  # one stands for its equals
        narrower = unsure.select("nid", "place", F.explode(cut(F.col("low"), F.col("high"))).alias("r")).groupBy("nid", "place").agg(F.collect_list("r").alias("ranges"))
        members = large.join(narrower, ["nid", "place"]).select("nid", "place", "left", "around", "ranges")


def around_anchors(hits: DataFrame, length: int) -> DataFrame:
    """gram, m, nid, place, left, around: the bytes about each anchor whose gram isn't single."""
    most = length - min(GRAM, length)
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "m", "nid", "place", "left", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for nid, text, found in zip(*(batch.column(n).to_pylist() for n in ("nid", "text", "anchors")), strict=True):
                data = text.encode()
                for a in found:
                    left = min(a["place"], most)
                    out.append((a["gram"], a["m"], nid, a["place"], left, data[a["place"] - left : a["place"] + length]))
                    if len(out) >= 4 * CHUNK:
                        yield packed(out)
                        out = []
            yield packed(out)

    return hits.mapInArrow(lean(run), "gram long, m long, nid long, place long, left long, around binary")


class Repeats:
    """What is repeated in the texts of a table (columns doc_id and text).

    rows: doc_id, h1, h2, sha256, n_bytes of each row; nodes: nid, h1, h2, rep (a document with
    the text), copies, n_bytes of each text; hits: nid, text of those that may hold
    a repeated string; spans: nid, spans (first and last + 1 of maximal repeated runs).
    Where only the spans are asked for, the tables of rows and hits are deleted once they are read.
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, spans_alone: bool = False):
        self.length = length
        modest_batches(docs.sparkSession)
        self.rows = materialize(anchored(docs, length))
        nodes = self.rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("places").alias("places"), F.first("grams").alias("grams"))
        with_anchors = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()))
        if spans_alone:
            discard(self.rows)
        self.nodes = materialize(with_anchors.drop("places", "grams"))
        release(docs.sparkSession)
        zipped = F.explode(F.arrays_zip("places", "grams")).alias("x")
        every = with_anchors.where(F.size("places") > 0).select("nid", zipped).select("nid", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"))
        counts = every.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
        found = every.join(counts, "gram").groupBy("nid").agg(F.collect_list(F.struct("place", "gram", "m")).alias("anchors"))
        found = found.join(self.nodes.select("nid", "h1", "h2", "rep"), "nid")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(k.alias(f"own_{i}") for i, k in enumerate(text_keys())))
        same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("own_0") == F.col("h1")) & (F.col("own_1") == F.col("h2"))
        self.hits = materialize(texts.join(found, same).select("nid", "text", "anchors"))
        discard(with_anchors)
        release(docs.sparkSession)
        around = around_anchors(self.hits, length)
        small = around.where(F.col("m") <= LARGE).repartition(n_partitions(docs.sparkSession), "gram").sortWithinPartitions("gram")
        in_memory = small.mapInArrow(lean(lambda batches: compare_groups(batches, length)), SPANS)
        pieces = materialize(in_memory)
        release(docs.sparkSession)
        if (large := materialize(around.where(F.col("m") > LARGE))).limit(1).count():
            pieces = pieces.union(large_groups(large, length))
        lists = pieces.groupBy("nid").agg(F.collect_set(F.struct("first", "last")).alias("pieces"))
        self.spans = lists.mapInArrow(join_spans, "nid long, spans array<struct<first:long,last:long>>")
        if spans_alone:
            self.spans = materialize(self.spans)
            discard(self.hits)
            release(docs.sparkSession)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


SPAN_LIST = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [[{"first": a, "last": b} for a, b in joined([(x["first"], x["last"]) for x in own])] for own in batch.column("pieces").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(lists, SPAN_LIST)], names=["nid", "spans"])


def kept_bytes(data: bytes, spans: list | None) -> bytes:
    out, at = [], 0
    for s in spans or ():
        out.append(data[at : s["first"]])
        at = s["last"]
    return b"".join([*out, data[at:]])


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    found = Repeats(docs, length)
    lost = F.col("copies") > 1
    parts = found.hits.select("nid", "text").join(found.spans, "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nid, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                kept = kept_bytes(data, spans)
                rows.append((nid, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["nid", "cut", "n", "kept"])

    cut = parts.select("nid", "text", "spans").mapInArrow(lean(run), "nid long, cut long, n long, kept string")
    cut = cut.join(found.nodes.where(~lost).select("nid"), "nid", "left_semi")  # equal rows of a text were each looked at
    nodes = found.nodes.select("nid", "h1", "h2", "copies").join(cut, "nid", "left").where(lost | F.col("cut").isNotNull()).drop("nid")
    out = found.rows.select("doc_id", "h1", "h2", "n_bytes", "sha256").join(nodes, ["h1", "h2"], "left")
    gone = F.coalesce(lost, F.lit(False)) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def n_words(data: bytes) -> int:
    return len(data.split())  # at bytes 0x20 and 0x09-0x0D


def cleaned(docs: DataFrame, length: int = LENGTH, least_words: int = 1) -> DataFrame:
    """The rows of docs, in whose text repeated strings are left out (null text stays null).

    Only maximal repeated runs of ``least_words`` words and more are left out, the words that
    a run cuts at its ends included.  All of docs' columns come back, whatever their names.
    """
    found = Repeats(docs, length, spans_alone=True)
    spans = found.nodes.select("nid", "h1", "h2", "copies", "n_bytes").join(found.spans, "nid", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("last")))
    cut = spans.withColumn("spans", F.when((F.col("copies") > 1) & (F.col("n_bytes") >= length), whole).otherwise(F.col("spans"))).where("spans IS NOT NULL")
    mark = "cut_" + "_" * max((len(c) for c in docs.columns), default=0)  # longer than any name there
    h1, h2, runs = (F.col(mark + n) for n in ("h1", "h2", "spans"))
    cut = cut.select(F.col("h1").alias(mark + "h1"), F.col("h2").alias(mark + "h2"), F.col("spans").alias(mark + "spans"))
    own = (F.xxhash64(F.coalesce(docs["text"], F.lit(""))), F.xxhash64(F.lit(7), F.coalesce(docs["text"], F.lit(""))))
    with_spans = docs.join(cut, (own[0] == h1) & (own[1] == h2), "left")

    @F.pandas_udf("string")
    def cleaned_text(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            data = None if t is None or own is None else t.encode()
            long = [] if data is None else [s for s in own if least_words <= 1 or n_words(data[s["first"] : s["last"]]) >= least_words]
            out.append(kept_bytes(data, long).decode(errors="ignore") if long else t)
        return pd.Series(out)

    text = F.when(runs.isNull(), docs["text"]).otherwise(cleaned_text(docs["text"], runs))
    return with_spans.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))
