"""A corpus as DataFrames, and what all queries on it share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import periods
from tracewright.plans import conditions
from tracewright.plans.config import Config
from tracewright.scratch import stored

NODE = "id string, kind string, path string, title string, status string, date string, line int, scalars map<string,string>, lists map<string,array<string>>, key_lines map<string,int>"
EDGE = "src string, dst string, type string, origin string, attrs map<string,string>"
FINDING = "severity string, rule string, id string, detail string, path string, line int, related array<string>, suppressed boolean"


def named_in(names: Column) -> Callable[[Column, Column], Column]:
    return lambda k, v: F.array_contains(names, k)


@dataclass(frozen=True)
class Corpus:
    """nodes (one for each id), edges (unique by src, dst, type), reference edges, retractions and findings of the build."""

    nodes: DataFrame
    edges: DataFrame
    cfg: Config
    as_of: str
    refs: DataFrame | None = None
    retractions: DataFrame | None = None
    documents: DataFrame | None = None
    build_findings: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def at(self, day: str) -> Corpus:
        return replace(self, as_of=day)

    @cached_property
    def dated(self) -> DataFrame:
        """nodes with their periods and in_force on the day asked for."""
        return periods.with_periods(self.nodes, self.edges, self.cfg, self.as_of)

    @property
    def recorded(self) -> DataFrame:
        """edges with those of their attributes that are declared and of a value that is taken."""
        kept = F.create_map().cast("map<string,string>")
        attrs = F.coalesce("attrs", kept)
        column = kept
        for e in self.cfg.edges:
            fits = [(F.lit(n), T.accepts(F.try_element_at(attrs, F.lit(n)), a.type, a.one_of)) for n, a in e.attrs]
            if fits:
                names = F.array_compact(F.array(*(F.when(ok, n) for n, ok in fits)))
                column = F.when(F.col("type") == e.name, F.map_filter(attrs, named_in(names))).otherwise(column)
        return self.edges.withColumn("attrs", column)

    def declared_by(self, edges: DataFrame) -> DataFrame:
        """edges with owner, the document that declares each: the source, or the target of reversed edges."""
        reverse = [e.name for e in self.cfg.edges if e.direction == "reverse"]
        derived = [d.edge for d in self.cfg.derived_edges if d.direction == "reverse"]
        turned = F.col("type").isin(reverse) | (F.col("type").isin(derived) & F.col("origin").startswith("derived"))
        return edges.withColumn("owner", F.when(turned, F.col("dst")).otherwise(F.col("src")))

    @cached_property
    def weighing(self) -> DataFrame:
        """Edges whose declarer is in force, and all of supersedes."""
        if not any(k.period for _, k in self.cfg.kind_items()):
            return self.edges
        owners = self.dated.select(F.col("id").alias("owner"), "in_force")
        held = self.declared_by(self.edges).join(owners, "owner", "left")
        return held.where((F.col("type") == "supersedes") | F.coalesce("in_force", F.lit(True))).select("src", "dst", "type", "origin", "attrs")

    @cached_property
    def frame(self) -> DataFrame:
        """dated nodes with projections: what conditions are answered on."""
        frame, _ = conditions.with_projections(self.dated, self.weighing, self.cfg)
        return frame

    def prepared(self) -> Corpus:
        """The same corpus with edges, dated and frame written once; whatever reads them no longer plans them anew.

        nodes are the columns of dated that they have; weighing is joined where it is read, for the types that are read.
        """
        out = replace(self, edges=stored(self.edges))
        dated = stored(out.dated)
        out = replace(out, nodes=dated.select(self.nodes.columns))
        out.__dict__.update(dated=dated, ends=out.edges)
        out.__dict__["frame"] = stored(out.frame)
        return out

    @cached_property
    def ends(self) -> DataFrame:
        """src, dst and type of edges, written once."""
        return stored(self.edges.select("src", "dst", "type"))

    @cached_property
    def unknown(self) -> DataFrame:
        """id of the ends of edges that no node has, written once: mostly few, so that joins with them are broadcast."""
        ends = self.ends.select(F.col("src").alias("id")).union(self.ends.select("dst")).distinct()
        return stored(ends.join(self.nodes.select("id"), "id", "left_anti"))

    @property
    def projections(self) -> list[str]:
        return [p.name for p in self.cfg.projections]

    def where(self, tests: dict) -> DataFrame:
        """Nodes that meet ad-hoc attribute tests, all of them."""
        out = self.frame
        for key, test in tests.items():
            out = out.where(conditions.attr_column(key, test, self.projections))
        return out

    def holding(self, **named) -> DataFrame:
        """frame with a boolean column for each condition given."""
        return conditions.with_conditions(self.frame, self.weighing, {k: (c,) for k, c in named.items()}, self.projections)

    @cached_property
    def binding(self) -> DataFrame:
        """Nodes of the binding projection."""
        projection = self.cfg.binding_projection()
        if projection.name in self.projections:
            return self.frame.where(F.col(conditions.PREFIX + projection.name))
        held = conditions.with_conditions(self.frame, self.weighing, {"binds": projection.any_of}, self.projections)
        return held.where("binds").drop("binds")


def first_declared(edges: DataFrame) -> DataFrame:
    """One edge for each src, dst and type: structured before derived, then the first declared (column seq)."""
    order = Window.partitionBy("src", "dst", "type").orderBy(F.col("origin").startswith("derived"), "seq")
    return edges.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "seq")
