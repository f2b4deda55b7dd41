"""Statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import checks, graph
from tracewright.operators.corpus import Corpus


def edge_counts(c: Corpus) -> DataFrame:
    """type, n of each declared edge type, zeros too, in the order of the configuration (column place)."""
    declared = c.spark.createDataFrame([(i, e.name) for i, e in enumerate(c.cfg.edges)], "place int, type string")
    return declared.join(c.edges.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("place", "type", F.coalesce("n", F.lit(0)).alias("n"))


def orphans(c: Corpus) -> DataFrame:
    """documents, orphans (on no typed edge) and their rate."""
    touched = c.edges.select(F.col("src").alias("id")).union(c.edges.select("dst")).distinct().withColumn("on", F.lit(1))
    both = c.nodes.select("id").join(touched, "id", "left")
    n, alone = F.count("*"), F.count_if(F.col("on").isNull())
    return both.agg(n.alias("documents"), alone.alias("orphans"), F.coalesce(alone / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("rate"))


def depth_histogram(c: Corpus, edge: str = "supersedes") -> DataFrame:
    """depth, n: nodes by the longest chain that starts at them; 0 for none."""
    deep = graph.depths(graph.steps(c.edges, [edge]))
    return c.nodes.select("id").join(deep, "id", "left").groupBy(F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth")).agg(F.count("*").alias("n"))


def most_referenced(c: Corpus, most: int = 10) -> DataFrame:
    """id, n of the documents that most references lead to."""
    refs = c.refs if c.refs is not None else c.edges.select("src", "dst")
    counts = refs.join(c.nodes.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "id").limit(most)


def clauses_by_topic(c: Corpus, kind: str = "topic") -> DataFrame:
    topics = c.nodes.where(F.col("kind") == kind).select("id")
    counts = c.edges.where("type = 'about'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return topics.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def modalities(c: Corpus) -> DataFrame:
    """modality, n: the vocabulary with zeros, then other words in use."""
    words = c.spark.createDataFrame([(w,) for w in T.KNOWN], "modality string")
    used = c.nodes.select(F.try_element_at("scalars", F.lit("modality")).alias("modality")).where("modality IS NOT NULL").groupBy("modality").agg(F.count("*").alias("n"))
    return words.join(used, "modality", "full_outer").select("modality", F.coalesce("n", F.lit(0)).alias("n"))


def suppressed_conflicts(c: Corpus) -> DataFrame:
    return checks.modality_pairs(c).agg(F.count_if(F.col("defeater").isNotNull()).alias("suppressed"), F.count_if(F.col("defeater").isNull()).alias("open"))


def field_usage(c: Corpus, changes: DataFrame | None = None) -> DataFrame:
    """key, documents, last_change, deprecated of every key written or declared; changes: path and day."""
    written = c.nodes.select("path", F.explode(F.map_keys("key_lines")).alias("key"))
    if changes is not None:
        days = changes.groupBy("path").agg(F.max("day").alias("day"))
        written = written.join(days, "path", "left")
    else:
        written = written.withColumn("day", F.lit(None).cast("string"))
    used = written.groupBy("key").agg(F.count("*").alias("documents"), F.max("day").alias("last_change"))
    declared = {name: f.deprecated for _, name, f in checks.declared_fields(c)}
    known = c.spark.createDataFrame([(k, d) for k, d in sorted(declared.items())], "key string, deprecated boolean")
    return used.join(known, "key", "full_outer").select("key", F.coalesce("documents", F.lit(0)).alias("documents"), "last_change", F.coalesce("deprecated", F.lit(False)).alias("deprecated"))


def firing(c: Corpus) -> DataFrame:
    """rule, fired, total: on how many nodes each rule holds, in one pass."""
    held = c.holding(**{f"rule_{i}": r.when for i, r in enumerate(c.cfg.rules)})
    counts = held.agg(F.count("*").alias("total"), *(F.count_if(f"rule_{i}").alias(f"n{i}") for i in range(len(c.cfg.rules))))
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("fired")) for i, r in enumerate(c.cfg.rules)))
    return counts.select(F.explode(each).alias("x"), "total").select("x.rule", "x.fired", "total")


def holding(c: Corpus) -> DataFrame:
    """projection, held, total: on how many nodes each projection holds."""
    counts = c.frame.agg(F.count("*").alias("total"), *(F.count_if(f"is_{p}").alias(p) for p in c.projections))
    each = F.array(*(F.struct(F.lit(p).alias("projection"), F.col(p).alias("held")) for p in c.projections))
    return counts.select(F.explode(each).alias("x"), "total").select("x.projection", "x.held", "total")
