"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size says how often each of its documents is wanted: a
whole number of copies and a fraction.  Two documents with fractions meet, and mass (words)
moves from one to the other at random, without bias, until one fraction is 0 or 1; the
other goes on to meet the next.  The words that a source takes are kept at every meeting,
so they end at most one document from its target.  Documents meet in blocks of their source,
chosen by a hash of the id; each block leaves one document with a fraction at most, and
these meet in a tree of blocks, one level after the other, until a source has one left,
which is rounded at random.  Randomness comes from hashes of the ids alone: reruns agree.

Null text has size 0; documents of size 0 take 0 words.  A null source is a source, the
last.  Each of repeated rows is a document; rows of one id are told apart by their texts, so
an id that many rows have is spread over the blocks.  An empty table has an empty result;
very long texts are only counted; columns other than doc_id, source and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, mix_int, n_partitions

MOST = 3
BLOCK_ROWS = 512
FAN_IN = 32
MAX_RANGES = 64
NEAR = 1e-12
STATE = "doc_id long, source string, size long, source_size long, target double, block long, place long, fraction double, copies int, mark long"
STATE_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()]
NAMES = [part.split()[0] for part in STATE.split(", ")]


def size_of(text: str):
    """The number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\x09-\\x0D]+")), F.lit(0)).cast("long")


def mark_of(text: str):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def taken(docs: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """The rows of docs as often as the mix takes them.

    Rows that share id, source and text take their copies together, as evenly as they can.
    """
    own = "mixed_" + "_" * max(map(len, docs.columns))  # longer than any name there
    chosen = mix(docs, weights).where("size > 0").groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias(own + "n"), F.count("*").alias(own + "m")).where(F.col(own + "n") > 0)
    chosen = chosen.withColumnsRenamed({"doc_id": own + "id", "source": own + "of", "mark": own + "mark"})
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own + "id")) & docs["source"].cast("string").eqNullSafe(F.col(own + "of")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(own + "mark"))
    met = docs.join(chosen, same)
    n, m, nth = (F.col(own + x) for x in ("n", "m", "nth"))
    single = met.where(m == 1).withColumn(own + "nth", F.lit(1))
    several = met.where(m > 1).withColumn(own + "nth", F.row_number().over(Window.partitionBy(own + "id", own + "of", own + "mark").orderBy(*docs.columns)))
    share = F.floor(n / m) + F.when(nth <= n % m, 1).otherwise(0)
    copies = single.unionByName(several).withColumn(own + "n", share.cast("int")).where(F.col(own + "n") > 0)
    return copies.select(*(F.col(c) for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(own + "n"))).alias(own + "n")).select(*docs.columns)


def numbered(df: DataFrame, *by) -> DataFrame:
    """Adds ``number``, each row's place from 0 in a global order, without bringing the rows to one task."""
    placed = materialize(df.repartitionByRange(min(MAX_RANGES, n_partitions(df.sparkSession)), *by).withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    parts = sorted(sizes)
    first = dict(zip(parts, accumulate((sizes[p] for p in parts), initial=0), strict=False))
    if not first:
        return placed.withColumn("number", F.lit(0).cast("long")).drop("part")
    start = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))[F.col("part")]
    return placed.withColumn("number", (start + F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1).cast("long")).drop("part")


def targets(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """source, source_size, target: shares of all words by weight, at most MOST times a source's size, the excess reshared."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sources, F.asc_nulls_last("source"))
    weight = F.array(*(F.lit(w) for w in weights))[F.pmod("number", F.lit(len(weights))).cast("int")]
    ranked = materialize(ranked.withColumn("weight", weight.cast("long")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * MOST
    level, capped = 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) > most
        row = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most).otherwise(0)).alias("at_most"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (total - row["at_most"]) / row["weight"]
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most.cast("double")).alias("target"))


def chance(a: int | None, b: int | None, level: int) -> float:
    return mix_int(mix_int((a if a is not None else -1) * 0x9E3779B97F4A7C15 + level) ^ ((b if b is not None else -1) * 0xC2B2AE3D27D4EB4F)) / 2.0**64


def settled(fraction: float) -> bool:
    return fraction <= NEAR or fraction >= 1 - NEAR


def meet(batches: Iterator[pa.RecordBatch], level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by source and block: all but one of each block leave with a null fraction and their copies."""
    group, waiting = None, None

    def end(row: list | None) -> list[list]:
        if row is not None and last:
            row[8] += chance(row[0], None, level) < row[7]
            row[7] = None
        return [] if row is None else [row]

    for batch in batches:
        out: list[list] = []
        for row in map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if (row[1], row[5]) != group:
                out += end(waiting)
                group, waiting = (row[1], row[5]), None
            if row[7] is None or row[2] == 0 or settled(row[7]):
                row[8] += row[7] is not None and row[7] > 0.5
                row[7] = None
                out.append(row)
            elif waiting is None:
                waiting = row
            else:
                a, b = waiting, row
                up = min(a[2] * (1 - a[7]), b[2] * b[7])  # words that may move to a
                down = min(a[2] * a[7], b[2] * (1 - b[7]))  # and to b
                moved = up if chance(a[0], b[0], level) * (up + down) < down else -down
                a[7] += moved / a[2]
                b[7] -= moved / b[2]
                waiting = None
                for x in (a, b):
                    if settled(x[7]):
                        x[8] += x[7] > 0.5
                        x[7] = None
                        out.append(x)
                    else:
                        waiting = x
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), STATE_KINDS, strict=True)], names=NAMES)
    if out := end(waiting):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), STATE_KINDS, strict=True)], names=NAMES)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, mark (a hash of the text) of each document: how often the mix takes it."""
    spark = docs.sparkSession
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), mark_of(text).alias("mark")))
    wanted = targets(sizes, weights)
    blocks = max(1, math.ceil(sizes.count() / BLOCK_ROWS))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    place = F.xxhash64("doc_id", "mark", F.lit(8))
    state = sizes.alias("s").join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", F.pmod(place, F.lit(blocks)).cast("long").alias("block"), place.alias("place"), (ratio - F.floor(ratio)).alias("fraction"), F.floor(ratio).cast("int").alias("copies"), "mark"
    )
    done: list[DataFrame] = []
    level = 0
    while True:
        last = blocks == 1
        ordered = state.repartition(n_partitions(spark), "source", "block").sortWithinPartitions("source", "block", "place", "doc_id", "size", "fraction")
        met = materialize(ordered.mapInArrow(lambda batches, level=level, last=last: meet(batches, level, last), STATE))
        done.append(met.where("fraction IS NULL"))
        if last:
            break
        blocks = math.ceil(blocks / FAN_IN)
        state = met.where("fraction IS NOT NULL").withColumn("block", F.pmod("block", F.lit(blocks)))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "mark")
