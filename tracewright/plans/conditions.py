"""Conditions compiled to columns, all of them over one frame of nodes.

The frame has a row for each node, whether it is in force, and the projections so far.
Degrees and one-hop clauses of all conditions in one direction are answered by one
aggregation each, over edges of the types that they name alone.  Every leaf is two-valued,
so that negation never meets null.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.plans.config import IN_FORCE, AttrTest, Condition, Config, Degree, Via, projection_order
from tracewright.scratch import stored

PREFIX = "is_"


def scalar(key: str, virtual: Iterable[str], at: str = "") -> Column:
    """An attribute's single value; projections and in_force stand before what a document says."""
    if key == IN_FORCE or key in virtual:
        return F.when(F.col(at + (key if key == IN_FORCE else PREFIX + key)), F.lit("true")).otherwise(F.lit("false"))
    return F.try_element_at(F.col(at + "scalars"), F.lit(key))


def items(key: str, virtual: Iterable[str], at: str = "") -> Column:
    """An attribute as a list; a single value is a list of one."""
    one = scalar(key, virtual, at)
    alone = F.when(one.isNotNull(), F.array(one))
    if key == IN_FORCE or key in virtual:
        return alone
    return F.coalesce(F.try_element_at(F.col(at + "lists"), F.lit(key)), alone)


def attr_column(key: str, test: AttrTest, virtual: Iterable[str], at: str = "") -> Column:
    """Case is ignored.  What is absent satisfies the negative tests alone."""
    if test.op in ("eq", "not"):
        equal = F.lower(scalar(key, virtual, at)) == test.value.lower()
        return F.coalesce(equal, F.lit(False)) if test.op == "eq" else F.coalesce(~equal, F.lit(True))
    if test.op == "subset_of":
        allowed = [v.lower() for v in test.value]
        return F.coalesce(F.forall(items(key, virtual, at), lambda x: F.lower(x).isin(allowed)), F.lit(False))
    has = F.coalesce(F.exists(items(key, virtual, at), lambda x: F.lower(x) == test.value.lower()), F.lit(False))
    return has if test.op == "contains" else ~has


def degree_column(d: Degree, name: str) -> Column:
    n = F.coalesce(F.col(name), F.lit(0))
    return (n >= d.least) & (n <= d.most) if d.most is not None else n >= d.least


def compiled(c: Condition, virtual: Iterable[str], hops: Mapping[tuple[str, Via | str], str]) -> Column:
    parts: list[Column] = []
    for d, side in ((c.inbound, "in"), (c.outbound, "out")):
        if d:
            parts.append(degree_column(d, hops[side, d.edge]))
    for e, side in ((c.not_inbound, "in"), (c.not_outbound, "out")):
        if e:
            parts.append(~degree_column(Degree(e), hops[side, e]))
    for v, side in ((c.via, "out"), (c.via_inbound, "in")):
        if v:
            parts.append(F.coalesce(F.col(hops[side, v]), F.lit(False)))
    parts += [attr_column(k, t, virtual) for k, t in c.attr]
    if c.any_of:
        parts.append(reduce(or_, (compiled(x, virtual, hops) for x in c.any_of)))
    if c.negated:
        parts.append(~compiled(c.negated, virtual, hops))
    return reduce(and_, parts) if parts else F.lit(True)


def frame_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with deg_in and deg_out, maps from edge type to the number of weighing edges.  Ends that no node has count."""
    out = nodes
    for side, name in (("dst", "deg_in"), ("src", "deg_out")):
        counts = edges.groupBy(F.col(side).alias("id"), "type").agg(F.count("*").alias("n"))
        maps = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias(name))
        out = out.join(maps, "id", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,bigint>")))
    return out


def with_conditions(frame: DataFrame, edges: DataFrame, conditions: Mapping[str, Iterable[Condition]], virtual: Iterable[str] = ()) -> DataFrame:
    """frame with a boolean column for each name: whether any of its conditions holds."""
    every = [n for cs in conditions.values() for c in cs for n in c.nested()]
    counted = [(side, e) for n in every for side, e in (("in", n.inbound and n.inbound.edge), ("out", n.outbound and n.outbound.edge), ("in", n.not_inbound), ("out", n.not_outbound)) if e]
    wanted = list(dict.fromkeys([*counted, *((side, v) for n in every for side, v in (("out", n.via), ("in", n.via_inbound)) if v)]))
    hops = {h: f"hop_{i}" for i, h in enumerate(wanted)}
    out = frame
    for side, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
        own = {e: name for (s, e), name in hops.items() if s == side and isinstance(e, str)}
        if own:
            counts = edges.where(F.col("type").isin(sorted(own))).groupBy(F.col(here).alias("id")).agg(*(F.count_if(F.col("type") == e).alias(name) for e, name in own.items()))
            out = out.join(counts, "id", "left")
        own = {v: name for (s, v), name in hops.items() if s == side and not isinstance(v, str)}
        if not own:
            continue
        tests = [reduce(and_, (attr_column(k, t, virtual) for k, t in v.attrs), F.lit(True)).alias(name) for v, name in own.items()]
        near = frame.select(F.col("id").alias("near"), *tests)
        steps = edges.where(F.col("type").isin(sorted({v.edge for v in own}))).select(F.col(here).alias("id"), F.col(there).alias("near"), "type")
        found = steps.join(near, "near").groupBy("id").agg(*(F.bool_or((F.col("type") == v.edge) & F.col(name)).alias(name) for v, name in own.items()))
        out = out.join(found, "id", "left")
    columns = {name: reduce(or_, (compiled(c, virtual, hops) for c in cs)) for name, cs in conditions.items()}
    return out.withColumns(columns).drop(*hops.values())


def with_projections(frame: DataFrame, edges: DataFrame, cfg: Config) -> tuple[DataFrame, list[str]]:
    """frame with is_<name> for each projection, those that read others after them; and the names."""
    done: list[str] = []
    left = projection_order(cfg)
    while left:
        names = {p.name for p in left}
        ready = [p for p in left if not set().union(*(c.attr_keys() for c in p.any_of)) & names]
        frame = with_conditions(frame, edges, {PREFIX + p.name: p.any_of for p in ready}, done)
        done += [p.name for p in ready]
        left = [p for p in left if p not in ready]
        if any(n.via or n.via_inbound for p in left for c in p.any_of for n in c.nested()):  # later layers read this one several times
            frame = stored(frame)
    for p in cfg.projections:
        if p.name not in done:
            frame = frame.withColumn(PREFIX + p.name, F.lit(False))
    return frame, [p.name for p in cfg.projections]
