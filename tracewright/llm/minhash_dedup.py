"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Every document's shingles are hashed once; its sketch is the ``KEPT`` smallest hashes,
   the retained values.  Documents of equal sets (by 128 bits) become one node at once, so
   copies never meet as pairs.
2. Linked sets of more than KEPT values have at least ``least_shared`` retained values in
   common, but for a chance of at most ``MISSED``, by the binomial tail: each of the KEPT
   smallest values of the union is in both sets with a chance of ``percent`` or more, and
   where it is, both retain it.  Smaller sets are retained whole; ``least_met`` counts what
   must then be common.  A node of whose retained values fewer are in others goes at once.
3. The nodes left take part with their whole sets (see the README for the figures of pairs made
   from retained values alone).  Sets are made anew from the texts of documents that pass a
   Bloom filter of the nodes left, which has at most ``MOST_BITS`` bits; texts are not shuffled.
   In any order of all values, a linked pair must meet in the first ``n - ceil(0.85 n) + 1``
   values of both, and at its first common value no more values may lie before than the two
   may differ in.  The order of the hashes comes first; a list of up to ``SHORT`` nodes is
   compared pair by pair.  Nodes in longer lists meet again among themselves in the order
   from the rarest value, in which edited copies part early.  In lists that are long even so,
   all are compared with the node that has fewest rare values; after that, only nodes
   outside its component are compared with the rest of the list.  So a group of near copies
   costs about a comparison for each member, and no list is cut.
4. The union sketch of a pair, the KEPT smallest values of both sketches together, estimates
   its likeness; pairs that can't reach the threshold end there, all others are confirmed
   on their whole sets.
5. Components are found by passing on the smallest label and following labels' labels.

Null, empty and wordless texts have empty sets and are linked with nothing, each on its
own.  Repeated rows are copies.  The smallest non-null id of a component is its id.  An
empty table has an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import U64, discard, lean, materialize, mix64, modest_batches
from tracewright.llm.shingles import shingles

KEPT = 48
MISSED = 2e-8
SHORT = 128
PERCENT = 85
MOST_BITS = 1 << 27
PROBES = 4


def least_shared(percent: int) -> int:
    """The most retained values of which KEPT draws with that chance fall short with a chance of MISSED at most."""
    p, below, n = percent / 100, 0.0, 0
    while n < KEPT:
        below += comb(KEPT, n) * p**n * (1 - p) ** (KEPT - n)
        if below > MISSED:
            break
        n += 1
    return max(1, n)


def set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit keys of a set."""
    if not len(hashes):
        return 0, 0
    keys = (mix64(hashes).sum(dtype=U64), mix64(hashes ^ U64(0x9E3779B97F4A7C15)).sum(dtype=U64))
    return tuple(int(mix64(np.array([k + U64(len(hashes))], dtype=U64)).view(np.int64)[0]) for k in keys)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n, h1, h2, sketch of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            keys = [set_keys(s) for s in sets]
            columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), lists([s[:KEPT].view(np.int64) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "h1", "h2", "sketch"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, mark long, n long, h1 long, h2 long, sketch array<long>")


def must_share(n, percent: int):
    """The smallest intersection that a set of n can be linked with: ceil(n * percent / 100)."""
    return F.expr(f"({n} * {percent} + 99) div 100")


def least_met(n: int, percent: int) -> int:
    """The least number of values of a set of n <= KEPT that a linked set retains, by all sizes m of that set: beyond KEPT its largest are not retained."""
    met = []
    for m in range(n, n * 100 // percent + 1):
        common = -(-percent * (n + m) // (100 + percent))
        met.append(common - max(0, m - KEPT))
    smaller = -(-percent * n // 100)  # of a linked set that is smaller or within this one
    return max(0, min(met + [smaller]))


def needed(percent: int):
    """How many retained values a node of n has in common with any that it is linked with."""
    small = F.array(*(F.lit(least_met(n, percent)) for n in range(1, KEPT + 1)))
    return F.when(F.col("n") <= KEPT, F.try_element_at(small, F.col("n").cast("int"))).otherwise(least_shared(percent))


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each id in a filter, a row for each probe."""
    first = mix64(ids.astype(U64) + U64(0x9E3779B97F4A7C15))
    step = mix64(first) | U64(1)
    return np.stack([(first + step * U64(i)) & U64(bits - 1) for i in range(PROBES)])


def id_array(column: pa.Array) -> np.ndarray:
    """Ids as numbers; null is -1, as an id may be as well."""
    return column.fill_null(-1).to_numpy(zero_copy_only=False).view(np.int64)


def id_filter(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """Words and number of nodes of a Bloom filter of the column rep."""
    n = nodes.count()
    bits = min(MOST_BITS, max(64, 1 << (10 * n - 1).bit_length())) if n else 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, dtype=U64)
        for batch in batches:
            at = places(id_array(batch.column(0)), bits).ravel()
            np.bitwise_or.at(words, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        there = np.flatnonzero(words)
        for i in range(0, len(there), 1 << 16):
            own = there[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words[own].view(np.int64))], names=["at", "word"])

    words = np.zeros(bits // 64, dtype=U64)
    found = nodes.select("rep").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words[found["at"].to_numpy()] = found["word"].to_numpy().view(U64)
    return words, n


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nid, n, s: the sorted hashes of the nodes' sets, from the texts of their documents."""
    words, n = id_filter(nodes)
    bits = len(words) * 64
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            at = places(id_array(batch.column(0)), bits)
            hopeful = np.flatnonzero((words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).all(axis=0))
            if not len(hopeful):
                continue
            own = batch.take(pa.array(hopeful))
            sets = [shingles(t) for t in own.column(1).to_pylist()]
            keys = [set_keys(s) for s in sets]
            columns = [own.column(0), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), lists([s.view(np.int64) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(lean(run), "doc_id long, h1 long, h2 long, s array<long>").alias("f")
    same = (F.col("f.h1") == F.col("k.h1")) & (F.col("f.h2") == F.col("k.h2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    sets = materialize(found.join(nodes.alias("k"), same).select("nid", F.size("s").cast("long").alias("n"), "s"))
    repeated = sets.count() != n  # an id stands on several rows
    return materialize(sets.dropDuplicates(["nid"])) if repeated else sets


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("the sets of one batch hold more than 2**31 - 1 values; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))


def keys_of(sets: DataFrame, percent: int) -> DataFrame:
    """v, nid, n, place: the rare values by which a node can meet a linked one, and their places in its order."""
    values = sets.select("nid", "n", F.explode("s").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ordered = values.join(shared, "v").groupBy("nid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("o"))
    lone = F.col("n") - F.size("o")
    length = F.col("n") - must_share("n", percent) + 1 - lone
    cut = ordered.where(length > 0).select("nid", "n", lone.alias("lone"), F.slice("o", F.lit(1), length.cast("int")).alias("o"))
    return cut.select("nid", "n", "lone", F.posexplode("o").alias("at", "x")).select(F.col("x.v").alias("v"), "nid", "n", (F.col("lone") + F.col("at")).alias("place"))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """v, nid, n, place: the smallest values, by one of which a node must meet a linked one."""
    length = F.col("n") - must_share("n", percent) + 1
    return sets.select("nid", "n", F.posexplode(F.slice("s", F.lit(1), length.cast("int"))).alias("place", "v")).select("v", "nid", "n", F.col("place").cast("long").alias("place"))


def in_lists(keys: DataFrame) -> DataFrame:
    """v, nid, n, place, and of the value's list its length m and its head, for values that several nodes have."""
    keys = materialize(keys)
    heads = keys.groupBy("v").agg(F.count("*").alias("m"), F.min(F.struct("place", "n", "nid")).alias("head")).where("m > 1")
    lists = materialize(keys.join(heads, "v").select("v", "nid", "n", "place", "m", F.col("head.nid").alias("head")))
    discard(keys)
    return lists


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs a < b that lists of up to SHORT nodes leave open."""
    x, y = (lists.where(F.col("m") <= SHORT).alias(name) for name in "xy")
    meets = (F.col("x.v") == F.col("y.v")) & (F.col("x.nid") < F.col("y.nid")) & may_link("x.", "y.", percent)
    return x.join(y, meets).select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"))


def may_link(a: str, b: str, percent: int):
    """By sizes, and by the places of the first common value."""
    sizes = F.expr(f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n)")
    left = F.expr(f"least({a}n - {a}place, {b}n - {b}place)")
    needed = F.expr(f"({percent} * ({a}n + {b}n) + {99 + percent}) div {100 + percent}")
    return sizes & (left >= needed)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that are linked, by the estimate of their union sketch and then on whole sets."""
    def side(name: str, values) -> DataFrame:
        return sets.select(F.col("nid").alias(name), F.col("n").alias(f"n{name}"), values.alias(f"s{name}"))

    few = F.slice("s", 1, KEPT)
    met = pairs.join(side("a", few), "a").join(side("b", few), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, KEPT)
    both_kept = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    hopeful = met.where((F.least("na", "nb") <= KEPT) | (both_kept >= least_shared(percent))).select("a", "b")
    whole = hopeful.join(side("a", F.col("s")), "a").join(side("b", F.col("s")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return whole.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """nid, label: the smallest node of each linked node's component."""
    both = materialize(links.union(links.select("b", "a")).toDF("nid", "other").distinct())
    labels = materialize(both.groupBy("nid").agg(F.least(F.min("other"), F.col("nid")).alias("label")))
    while True:
        passed = both.join(labels.toDF("other", "label"), "other").groupBy("nid").agg(F.min("label").alias("theirs"))
        near = labels.join(passed, "nid").select("nid", "label", F.least("label", "theirs").alias("near"))
        jumped = near.join(labels.toDF("near", "far"), "near")
        new = materialize(jumped.select("nid", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new.select("nid", "label")
        if not moved:
            discard(both)
            return labels


def judged(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, mark, label, component of each row of docs (columns doc_id and text).

    mark: a hash of the text; label: the same number for all of a group, null without words; component: its smallest id.
    """
    modest_batches(docs.sparkSession)
    base = materialize(sketched(docs))
    nodes = base.where("n > 0").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()))

    retained = nodes.select("nid", F.explode("sketch").alias("v"))
    shared = retained.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    met = retained.join(shared, "v").groupBy("nid").agg(F.count("*").alias("met"))
    hopeful = nodes.join(met, "nid").where(F.col("met") >= needed(percent)).select("nid", "h1", "h2", "rep")
    hopeful = materialize(hopeful)
    sets = whole_sets(docs, hopeful)
    discard(hopeful)

    lists = in_lists(prefixes(sets, percent))
    pairs = short_pairs(lists, percent)
    hot = materialize(lists.where(F.col("m") > SHORT).select("nid").distinct())
    hot_lists = in_lists(keys_of(sets.join(hot, "nid", "left_semi"), percent))
    long_lists = hot_lists.where(F.col("m") > SHORT)
    pairs = pairs.union(short_pairs(hot_lists, percent))
    with_head = long_lists.where(F.col("nid") != F.col("head")).select(F.least("nid", "head").alias("a"), F.greatest("nid", "head").alias("b"))
    links = materialize(confirmed(pairs.union(with_head).distinct(), sets, percent))
    labels = components(links)

    labelled = long_lists.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    named = materialize(labelled.join(labels.toDF("head", "head_label"), "head", "left").withColumn("out", F.col("label") != F.coalesce("head_label", "head")))
    x, y = named.where("out").alias("x"), named.alias("y")
    apart = (F.col("x.v") == F.col("y.v")) & (F.col("x.label") != F.col("y.label")) & (~F.col("y.out") | (F.col("x.nid") < F.col("y.nid"))) & may_link("x.", "y.", percent)
    rest = x.join(y, apart).select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()
    more = materialize(confirmed(rest, sets, percent))
    if more.limit(1).count():
        labels = components(links.union(more))

    node_labels = nodes.select("nid", "h1", "h2", "rep").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    least_ids = node_labels.groupBy("label").agg(F.min("rep").alias("component"))
    owners = node_labels.join(least_ids, "label").select("h1", "h2", "label", "component")
    return base.drop("sketch").join(owners, ["h1", "h2"], "left").select("doc_id", "n", "mark", "label", "component")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (columns doc_id and text)."""
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return judged(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near duplicates: of each group the row of smallest id (null last), then of
    smallest text hash, stays, once; so do all rows without words."""
    texts = judged(docs.select("doc_id", "text"), percent).groupBy("doc_id", "mark").agg(F.count("*").alias("rows"), F.first("label").alias("label"))
    texts = materialize(texts)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "rows")).alias("first")
    stay = texts.where("label IS NOT NULL").groupBy("label").agg(first).select("first.doc_id", "first.mark", "first.rows")
    stay = stay.unionByName(texts.where("label IS NULL").select("doc_id", "mark", F.lit(1).cast("long").alias("rows"))).toDF("stay_id", "stay_mark", "rows")
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_mark")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), own)
    met = named.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_mark") == F.col("stay_mark")))
    repeated = met.where("rows > 1").withColumn("nth", F.row_number().over(Window.partitionBy("own_id", "own_mark").orderBy("row"))).where("nth = 1")
    return met.where("rows = 1").select("row.*").unionByName(repeated.select("row.*"))
