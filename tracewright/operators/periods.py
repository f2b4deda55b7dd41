"""Valid time: half-open periods of days, [from, until)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import valid_day
from tracewright.plans.config import Config


def by_kind(cfg: Config, value) -> Column:
    """A column that depends on a node's kind; null where value is."""
    if not cfg.multikind:
        return value(cfg.kind(""))
    return reduce(lambda otherwise, k: F.when(F.col("kind") == k[0], value(k[1])).otherwise(otherwise), reversed(cfg.kind_items()), F.lit(None))


def written(key: str) -> Column:
    return F.col("date") if key == "date" else F.try_element_at("scalars", F.lit(key))


def with_periods(nodes: DataFrame, edges: DataFrame, cfg: Config, as_of: str) -> DataFrame:
    """Adds declared, from_day, explicit_until, derived_until, until_day and in_force.

    A bad day constrains nothing.  Without an explicit end, a node's period ends when the
    earliest of its accepted successors begins; a successor of a kind without
    periods begins on its date.
    """
    if not any(k.period for _, k in cfg.kind_items()):
        none = {c: F.lit(None).cast("string") for c in ("from_day", "explicit_until", "derived_until", "until_day")}
        return nodes.withColumns({"declared": F.lit(False), **none, "in_force": F.lit(True)})
    declared = F.coalesce(by_kind(cfg, lambda k: F.lit(k.period is not None)), F.lit(False))
    start = by_kind(cfg, lambda k: written(k.period.start) if k.period else F.lit(None).cast("string"))
    end = by_kind(cfg, lambda k: written(k.period.until) if k.period else F.lit(None).cast("string"))
    own = nodes.withColumns({"declared": declared, "from_day": valid_day(start), "explicit_until": valid_day(end)})
    begins = own.where(F.lower("status") == "accepted").select(F.col("id").alias("src"), F.when(F.col("declared"), F.col("from_day")).otherwise(valid_day(F.col("date"))).alias("begins")).where("begins IS NOT NULL")
    ends = edges.where("type = 'supersedes'").join(begins, "src").groupBy(F.col("dst").alias("id")).agg(F.min("begins").alias("derived_until"))
    dated = own.join(ends, "id", "left")
    dated = dated.withColumn("derived_until", F.when(F.col("declared"), F.col("derived_until")))
    dated = dated.withColumn("until_day", F.coalesce("explicit_until", "derived_until"))
    begun = F.col("from_day").isNull() | (F.col("from_day") <= as_of)
    ended = F.coalesce(F.col("until_day") <= as_of, F.lit(False))
    return dated.withColumn("in_force", ~F.col("declared") | (begun & ~ended))
