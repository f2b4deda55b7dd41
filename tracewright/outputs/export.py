"""A corpus as a diagram or as node-link JSON: lines over the nodes and edges that are shown."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators.corpus import Corpus

LABEL = 40


def drawable(c: Corpus, edges: DataFrame) -> DataFrame:
    """Edges between known documents."""
    ids = c.nodes.select("id")
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def shown(c: Corpus, types: list[str] | None = None, connected: bool = False, references: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (typed ones; references as well, if asked, between shown nodes) of a rendering."""
    own = c.recorded
    typed = drawable(c, own if not types else own.where(F.col("type").isin(types))).select("src", "type", "dst", "origin", "attrs")
    nodes = c.nodes
    if connected:
        ends = typed.select(F.col("src").alias("id")).union(typed.select("dst")).distinct()
        nodes = nodes.join(ends, "id", "left_semi")
    edges = typed.withColumn("layer", F.lit("typed"))
    if references and c.refs is not None:
        ids = nodes.select("id")
        refs = drawable(c, c.refs).join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        none = F.create_map().cast("map<string,string>")
        edges = edges.unionByName(refs.select("src", F.lit("references").alias("type"), "dst", F.lit("body").alias("origin"), none.alias("attrs"), F.lit("reference").alias("layer")))
    return nodes, edges


def label(limit: int = LABEL) -> Column:
    return T.label(F.concat_ws(" ", "id", F.when(F.col("title") != "", F.col("title"))), limit)


def node_line(how: str, limit: int = LABEL) -> Column:
    if how == "json":
        return F.to_json(F.struct("id", "title", "status", "path"))
    pattern = '  %s["%s"]' if how == "mermaid" else '  "%s" [label="%s"];'
    return F.format_string(pattern, F.col("id"), label(limit))


def edge_line(how: str) -> Column:
    typed = F.col("layer") == "typed"
    if how == "json":
        attrs = F.when(F.size("attrs") > 0, F.col("attrs"))
        return F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type", "origin", attrs.alias("attrs")))
    if how == "mermaid":
        return F.when(typed, F.format_string("  %s -->|%s| %s", F.col("src"), F.col("type"), F.col("dst"))).otherwise(F.format_string("  %s -.-> %s", F.col("src"), F.col("dst")))
    return F.when(typed, F.format_string('  "%s" -> "%s" [label="%s"];', F.col("src"), F.col("dst"), F.col("type"))).otherwise(F.format_string('  "%s" -> "%s" [style=dotted];', F.col("src"), F.col("dst")))


def lines(c: Corpus, how: str, limit: int = LABEL, **options) -> tuple[DataFrame, DataFrame]:
    """text of the nodes and of the edges, with their keys."""
    nodes, edges = shown(c, **options)
    return nodes.select("id", node_line(how, limit).alias("text")), edges.select("layer", "src", "type", "dst", edge_line(how).alias("text"))


OPENING = {"mermaid": ["graph LR"], "dot": ["digraph corpus {", "  rankdir=LR;"], "json": ['{"nodes": [']}
CLOSING = {"mermaid": [], "dot": ["}"], "json": ["]}"]}


def written(c: Corpus, how: str, **options) -> Iterator[str]:
    """A whole export: nodes by id, typed edges by source, type and target, references last."""
    from tracewright.outputs.reports import joined

    nodes, edges = lines(c, how, **options)
    first = (r.text for r in nodes.orderBy("id").select("text").toLocalIterator())
    then = (r.text for r in edges.orderBy(F.desc("layer"), "src", "type", "dst").select("text").toLocalIterator())
    yield from OPENING[how]
    if how == "json":
        yield from joined(first)
        yield '], "links": ['
        yield from joined(then)
    else:
        yield from first
        yield from then
    yield from CLOSING[how]
