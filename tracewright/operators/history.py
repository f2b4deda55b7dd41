"""Two states of a corpus: differences, and what closed documents may change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.corpus import Corpus

CLOSED = ("accepted", "superseded", "withdrawn")


def document_changes(base: Corpus, target: Corpus) -> DataFrame:
    """op (added, removed, status), id, before, after."""
    a = base.nodes.select("id", F.col("status").alias("before"), F.lit(True).alias("was"))
    b = target.nodes.select("id", F.col("status").alias("after"), F.lit(True).alias("is"))
    both = a.join(b, "id", "full_outer")
    op = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "status")
    return both.select(op.alias("op"), "id", "before", "after").where("op IS NOT NULL")


def edge_changes(base: Corpus, target: Corpus) -> DataFrame:
    """op (added, removed), type, src, dst; attributes and origin don't matter."""
    key = ["type", "src", "dst"]
    sides = base.edges.select(*key, F.lit(1).alias("side")).unionByName(target.edges.select(*key, F.lit(2).alias("side")))
    alone = sides.groupBy(key).agg(F.bit_or("side").alias("sides")).where("sides < 3")
    return alone.select(F.when(F.col("sides") == 2, "added").otherwise("removed").alias("op"), *key)


def binding_delta(base: Corpus, target: Corpus) -> DataFrame:
    """before, after: sizes of the binding sets."""
    return base.binding.agg(F.count("*").alias("before")).join(target.binding.agg(F.count("*").alias("after")))


def rule_changes(base: Corpus, target: Corpus) -> DataFrame:
    """rule, change: rules that fire in one state alone."""
    from tracewright.operators import stats

    a, b = stats.firing(base).select("rule", F.col("fired").alias("before")), stats.firing(target).select("rule", F.col("fired").alias("after"))
    both = a.join(b, "rule", "full_outer")
    change = F.when((F.coalesce("before", F.lit(0)) == 0) & (F.col("after") > 0), "newly_fired").when((F.col("before") > 0) & (F.coalesce("after", F.lit(0)) == 0), "stopped_firing")
    return both.select("rule", change.alias("change")).where("change IS NOT NULL")


def change_feed(base: DataFrame, target: DataFrame) -> DataFrame:
    """path and op (A, M, D) of files, by content."""
    a = base.select("path", F.sha2("content", 256).alias("old"))
    b = target.select("path", F.sha2("content", 256).alias("new"))
    op = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    return a.join(b, "path", "full_outer").select("path", op.alias("op")).where("op IS NOT NULL")


def immutable_violations(base: DataFrame, target: DataFrame, appendable: tuple[str, ...] = (), status: str = "status") -> DataFrame:
    """path, what: changes of closed documents beyond status, growth of appendable keys, and text added at the end.

    base and target: path, status, attrs (map from key to text, lists as JSON), body.
    """
    closed = base.where(F.lower("status").isin(*CLOSED)).select("path", F.col("attrs").alias("old"), F.col("body").alias("old_body"))
    both = closed.join(target.select("path", F.col("attrs").alias("new"), F.col("body").alias("new_body"), F.lit(True).alias("there")), "path", "left")
    gone = both.where("there IS NULL").select("path", F.lit("is gone").alias("what"))
    kept = both.where("there IS NOT NULL")
    keys = kept.select("path", F.explode(F.array_union(F.map_keys("old"), F.map_keys("new"))).alias("key"), "old", "new").where(F.col("key") != status)
    keys = keys.select("path", "key", F.try_element_at("old", F.col("key")).alias("was"), F.try_element_at("new", F.col("key")).alias("now")).where(~F.col("was").eqNullSafe(F.col("now")))
    as_list = lambda c: F.coalesce(F.from_json(F.when(F.col(c).startswith("["), F.col(c)), "array<string>"), F.when(F.col(c).isNotNull(), F.array(c)), F.array().cast("array<string>"))
    grows = F.col("key").isin(*appendable) & (F.size(F.array_except(as_list("was"), as_list("now"))) == 0) if appendable else F.lit(False)
    changed = keys.where(~grows).select("path", F.concat(F.lit("changes "), F.col("key")).alias("what"))
    old, new = F.split(F.rtrim("old_body"), "\n"), F.split(F.rtrim("new_body"), "\n")
    body = kept.where(~((F.trim("old_body") == "") | (F.slice(new, 1, F.size(old)) == old))).select("path", F.lit("changes text").alias("what"))
    return gone.unionByName(changed).unionByName(body)
