"""Exact top-k inner products by Fagin's threshold algorithm.

Rows are dealt into blocks of bounded size; a task reads a block, sorts it once and then
answers the queries that follow it, batch by batch, so neither side is ever whole in
memory.  In a block, every dimension has a list of the rows in order of that component.
Sorted access goes down all lists in lockstep, from the high end for positive and the low
end for negative weights; rows met for the first time are scored in full, for all queries
of the batch that are still open.  No row that was not met can score above the sum of the
weights times the components last seen in the lists; a query is closed when its kth score
is above that bound (an equal score may still win by a smaller id).

Each query is answered by one block first.  Its kth score there travels with it to the
other blocks: a block whose best possible score is below it is not searched at all, and the
others close and answer by it as well.  Each block's best are merged for each query.

Vectors that are null, or hold a null or non-finite component, and rows without an id
take no part.  A component x counts as floor(64 * x).  Shorter vectors are as if filled up
with zeros.  Rows of a query's own id are no candidates; of other repeated ids each row
is one.  Queries of one id are answered together.  Ties go to the smaller id.  An empty table
has an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, n_partitions

BLOCK_ROWS = 16384
QUERIES_AT_ONCE = 1024
FIRST_DEPTH = 64
EXACT = 2.0**52


def matrix(chunk: pa.ListArray, width: int) -> np.ndarray:
    """floor(64 * x) of an array of vectors."""
    out = np.zeros((len(chunk), width))
    ends = chunk.offsets.to_numpy()
    values = np.floor(64.0 * chunk.values.to_numpy(zero_copy_only=False).astype(np.float64))
    if len(chunk) and (np.diff(ends) == width).all():
        return values[ends[0] : ends[-1]].reshape(len(chunk), width)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def scores_of(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as integers: in floating point while that is exact."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if most < EXACT:
        return (queries @ rows.T).astype(np.int64)
    return np.clip(queries, -(2.0**62), 2.0**62).astype(np.int64) @ np.clip(rows, -(2.0**62), 2.0**62).astype(np.int64).T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to the smaller id; ids: one for each column or, in a matrix, for each cell."""
    n = scores.shape[1]
    if n <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    cut = np.partition(scores, n - k, axis=1)[:, n - k]
    out_scores = np.empty((len(scores), k), dtype=np.int64)
    out_ids = np.empty((len(scores), k), dtype=np.int64)
    for i, row in enumerate(scores):
        at = np.flatnonzero(row >= cut[i])
        own = ids[at] if ids.ndim == 1 else ids[i, at]
        if len(at) > k:
            order = np.lexsort((own, -row[at]))[:k]
            at, own = at[order], own[order]
        out_scores[i], out_ids[i] = row[at], own
    return out_scores, out_ids


LOWEST = np.iinfo(np.int64).min + 1  # can be negated


class Block:
    """Rows, and their places in the order of each component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable")

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows for each query, LOWEST where there are fewer; least: scores below these don't matter."""
        n, width = self.rows.shape
        rows, order = self.rows, self.order
        least = np.full(len(queries), LOWEST) if least is None else least
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        best_scores = np.full((len(queries), k), LOWEST)
        best_ids = np.zeros((len(queries), k), dtype=np.int64)
        first, last = rows[order[0], np.arange(width)], rows[order[-1], np.arange(width)]
        open_queries = np.flatnonzero(~(least > up @ last + down @ first))
        seen = np.zeros(n, dtype=bool)
        depth = 0
        while len(open_queries) and not seen.all():
            before, depth = depth, min(n, max(FIRST_DEPTH, 2 * depth))
            met = np.zeros(n, dtype=bool)
            met[order[before:depth, (down[open_queries] < 0).any(0)]] = True
            met[order[n - depth : n - before, (up[open_queries] > 0).any(0)]] = True
            if depth == n:
                met[:] = True  # all weights of some query may be zero
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met)
            if len(new):
                scores = scores_of(queries[open_queries], rows[new])
                scores[query_ids[open_queries][:, None] == self.ids[new][None, :]] = LOWEST
                found = best_of(scores, self.ids[new], k)
                both = np.concatenate([best_scores[open_queries], found[0]], axis=1), np.concatenate([best_ids[open_queries], found[1]], axis=1)
                best_scores[open_queries], best_ids[open_queries] = best_of(*both, k)
            high, low = rows[order[n - depth], np.arange(width)], rows[order[depth - 1], np.arange(width)]
            bound = up[open_queries] @ high + down[open_queries] @ low
            open_queries = open_queries[~(np.maximum(best_scores[open_queries].min(1), least[open_queries]) > bound)]
        best_scores[best_scores < least[:, None]] = LOWEST
        return best_scores, best_ids


FOUND = ["query_id", "key", "vec_id", "score"]


def answers(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by block, a block's vectors before its queries."""
    at, ids, parts, block = None, [], [], None
    for batch in batches:
        blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks) | np.diff(asks)) + 1
        for first, last in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if first == last:
                continue
            own = batch.slice(first, last - first)
            if blocks[first] != at:
                at, ids, parts, block = blocks[first], [], [], None
            if not asks[first]:
                ids.append(own.column("id").to_numpy())
                parts.append(matrix(own.column("v"), width))
                continue
            if not ids:
                continue  # no vectors were dealt here
            if block is None:
                block = Block(np.concatenate(ids), np.concatenate(parts))
                parts = []
            for i in range(0, len(own), QUERIES_AT_ONCE):
                some = own.slice(i, QUERIES_AT_ONCE)
                query_ids, keys = some.column("id").to_numpy(), some.column("key").to_numpy()
                scores, found = block.search(query_ids, matrix(some.column("v"), width), k, some.column("least").to_numpy())
                there = scores > LOWEST
                times = there.sum(1)
                columns = [np.repeat(query_ids, times), np.repeat(keys, times), found[there], scores[there]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=FOUND)


def top_k(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of df for each row where the column ``is_query`` holds."""
    spark = df.sparkSession
    named = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    valid = named.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    # each row gets a number of its own, so that a repeated id or vector is spread over the blocks
    valid = materialize(valid.select("id", F.col("v").cast("array<double>").alias("v"), "q", F.monotonically_increasing_id().alias("key")))
    n, width = valid.select(F.count("*"), F.max(F.size("v"))).first()
    width, blocks = width or 0, max(1, math.ceil(n / BLOCK_ROWS))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    vectors = valid.select(block, F.lit(0).alias("asks"), "key", "id", F.lit(LOWEST).alias("least"), "v")

    def asked(queries: DataFrame) -> DataFrame:
        both = vectors.unionByName(queries).repartition(n_partitions(spark), "block").sortWithinPartitions("block", "asks")
        return both.mapInArrow(lambda batches: answers(batches, width, k), "query_id long, key long, vec_id long, score long")

    queries = valid.where("q")
    own = asked(queries.select(block, F.lit(1).alias("asks"), "key", "id", F.lit(LOWEST).alias("least"), "v"))
    found = own
    if blocks > 1:
        found = own = materialize(own)
        kth = own.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("key", "kth")
        told = queries.join(kth, "key", "left").select("key", "id", "v", F.coalesce("kth", F.lit(LOWEST)).alias("least"), block.alias("home"))
        others = told.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "key", "id", "least", "v", "home").where("block <> home").drop("home")
        found = own.unionByName(asked(others))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
