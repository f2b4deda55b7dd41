"""Briefs: what one should read beside a document, for any number of documents at once.

A brief has the document, what it resolves to, its normative neighbours, and what is near
it upward and downward.  Each neighbour is told once, by the first group that claims it.
Excerpts are given while they fit a budget of tokens.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import checks, graph
from tracewright.operators.corpus import Corpus
from tracewright.scratch import stored

DEPTH = 1
BUDGET = 2000
SECTION = "Decision"
GROUPS = ("ref", "resolves to", "related", "ancestors", "descendants")
RELATIONS = ("about", "excepts", "excepted by", "interop", "same topic")
TITLE = re.compile(r"^#{2,3} (.*)$")
MARKS = ("```", "~~~")


def excerpt(body: str | None, wanted: str = SECTION) -> str:
    """The first paragraph under the heading (of level 2 or 3) that fits best: the words themselves,
    the words and "Outcome", or words that begin so; the first of equals.  Fenced headings don't count."""
    rows = [r.rstrip(" \t") for r in (body or "").replace("\r\n", "\n").split("\n")]
    want, fits, inside = wanted.lower(), [], None
    for i, row in enumerate(rows):
        mark = next((m for m in MARKS if row.lstrip(" ").startswith(m)), None)
        if mark:
            inside = mark if inside is None else None if inside == mark else inside
            continue
        m = TITLE.match(row) if inside is None else None
        if m:
            title = m[1].rstrip("# ").strip().lower()
            if title.startswith(want):
                fits.append(({want: 0, f"{want} outcome": 1}.get(title, 2), i))
    if not fits:
        return ""
    left = iter(rows[min(fits)[1] + 1 :])
    first = next((r for r in left if r.strip()), "")
    if first.startswith("#"):
        return ""
    paragraph = [first]
    for row in left:
        if not row.strip() or row.startswith("#"):
            break
        paragraph.append(row)
    return "\n".join(paragraph).rstrip()


def excerpts(bodies: DataFrame, section: str = SECTION) -> DataFrame:
    """id and excerpt of rows with id and body."""
    cut = F.pandas_udf(lambda s: s.map(lambda b: excerpt(b, section), na_action=None).astype(object), "string")
    return bodies.select("id", cut("body").alias("excerpt"))


def known_pairs(c: Corpus, types: list[str] | None, reverse: bool = False) -> DataFrame:
    ids = c.nodes.select("id")
    return graph.steps(c.edges, types, reverse).join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def related(c: Corpus, starts: DataFrame) -> DataFrame:
    """start, id, relation: topics, exceptions both ways, interplay, and binding clauses on the same topic."""
    own = starts.select(F.col("id").alias("src"))
    parts = []

    def along(edge: str, relation: str, reverse: bool = False) -> None:
        if c.cfg.edge(edge):
            pairs = known_pairs(c, [edge], reverse)
            parts.append(pairs.join(own, "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("id"), F.lit(relation).alias("relation")))

    along("about", "about")
    along("excepts", "excepts")
    along("excepts", "excepted by", reverse=True)
    along("interop", "interop")
    if c.cfg.edge("about"):
        topics = known_pairs(c, ["about"]).join(own, "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("topic"))
        bound = c.binding.select(F.col("id").alias("src"))
        speakers = graph.steps(c.edges, ["about"]).join(bound, "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("topic"))
        parts.append(topics.join(speakers, "topic").where("start <> id").select("start", "id", F.lit("same topic").alias("relation")).distinct())
    if not parts:
        return c.spark.createDataFrame([], "start string, id string, relation string")
    return reduce(DataFrame.unionByName, parts)


def place_of(names: tuple[str, ...], column: str) -> Column:
    return F.array_position(F.array(*(F.lit(n) for n in names)), F.col(column)).cast("int")


def entries(c: Corpus, starts: DataFrame, depth: int = DEPTH, types: list[str] | None = None, everything: bool = False) -> DataFrame:
    """start, part, relation, id, seq: each neighbour once, in the order in which a brief names them.

    Ancestors and descendants are those of the binding set, unless everything is asked for.
    """
    ids = c.nodes.select("id")
    starts = stored(starts.select("id").join(ids, "id", "left_semi").distinct())
    none = F.lit(None).cast("string")
    parts = [starts.select(F.col("id").alias("start"), "id", F.lit("ref").alias("part"), none.alias("relation"))]
    if c.cfg.edge("supersedes"):
        parts.append(graph.resolve(c, starts)[0].select("start", "id", F.lit("resolves to").alias("part"), none.alias("relation")))
    parts.append(related(c, starts).select("start", "id", F.lit("related").alias("part"), "relation"))
    bound = c.binding.select("id")
    for part, reverse in (("ancestors", True), ("descendants", False)):
        near = graph.reachable(known_pairs(c, types, reverse), starts, depth).select("start", "id")
        near = near if everything else near.join(bound, "id", "left_semi")
        parts.append(near.select("start", "id", F.lit(part).alias("part"), none.alias("relation")))
    every = reduce(DataFrame.unionByName, parts).withColumn("rank", place_of(GROUPS, "part") * 10 + F.coalesce(place_of(RELATIONS, "relation"), F.lit(0)))
    claimed = every.groupBy("start", "id").agg(F.min(F.struct("rank", "part", "relation")).alias("first"))
    seq = F.row_number().over(Window.partitionBy("start").orderBy("rank", "id"))
    return claimed.select("start", "id", "first.*").withColumn("seq", seq).select("start", "part", "relation", "id", "seq")


def entry_line() -> Column:
    relation = F.when(F.col("relation").isNotNull(), F.concat(F.lit("  ("), F.col("relation"), F.lit(")"))).otherwise("")
    return F.concat(F.concat_ws("  ", "id", F.coalesce("title", F.lit("")), F.concat(F.lit("["), F.coalesce("status", F.lit("")), F.lit("]")), F.coalesce("path", F.lit(""))), relation)


def briefs(c: Corpus, starts: DataFrame, budget: int = BUDGET, section: str = SECTION, bodies: DataFrame | None = None, **how) -> DataFrame:
    """entries with title, status, path, line, excerpt, degraded.

    Lines cost their tokens in any case.  Excerpts are kept in order as long as all up to them fit the
    budget (0: no limit); a running sum never falls, so the first that doesn't fit ends them.
    """
    told = entries(c, starts, **how).join(c.nodes.select("id", "title", "status", "path"), "id").withColumn("text", entry_line())
    if bodies is None and c.documents is not None:
        bodies = c.documents.where("id IS NOT NULL").groupBy("id").agg(F.max_by("body", "path").alias("body"))
    if bodies is not None:
        told = told.join(excerpts(bodies, section), "id", "left").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))
    else:
        told = told.withColumn("excerpt", F.lit(""))
    whole = Window.partitionBy("start")
    cost = T.tokens(F.col("excerpt"))
    used = F.sum(T.tokens(F.col("text"))).over(whole) + F.sum(cost).over(whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = (F.col("excerpt") != "") & (used > budget) if budget > 0 else F.lit(False)
    told = told.withColumn("degraded", over)
    return told.select("start", "seq", "part", "relation", "id", "title", "status", "path", "text", F.when(F.col("degraded"), "").otherwise(F.col("excerpt")).alias("excerpt"), "degraded")


def budgets(told: DataFrame, limit: int = BUDGET) -> DataFrame:
    """start, limit, used, degraded."""
    used = F.sum(T.tokens(F.col("text")) + T.tokens(F.col("excerpt")))
    return told.groupBy("start").agg(F.lit(limit).alias("limit"), used.alias("used"), F.count_if("degraded").alias("degraded"))


def suppressed(c: Corpus, starts: DataFrame) -> DataFrame:
    """start and text of the conflicts about each start that a recorded exception settles."""
    if c.cfg.edge("about") is None:
        return c.spark.createDataFrame([], "start string, text string")
    pairs = checks.modality_pairs(c).where("defeater IS NOT NULL").withColumn("text", checks.settled_text())
    sides = pairs.select(F.explode(F.array("a", "b")).alias("start"), "text")
    return sides.join(starts.select(F.col("id").alias("start")), "start", "left_semi")


def retracted(c: Corpus, starts: DataFrame) -> DataFrame:
    """start and text of the retractions that name each start, at either end or as their maker."""
    if c.retractions is None:
        return c.spark.createDataFrame([], "start string, text string")
    line = F.format_string("%s %s -> %s (by %s)", F.col("type"), F.col("src"), F.col("dst"), F.col("by"))
    named = c.retractions.select(F.explode(F.array_distinct(F.array("src", "dst", "by"))).alias("start"), line.alias("text"))
    return named.join(starts.select(F.col("id").alias("start")), "start", "left_semi")


def indented(text: Column, by: str) -> Column:
    return F.concat(F.lit(by), F.regexp_replace(text, "\n", "\n" + by))


def outlines(told: DataFrame, how: str = "text", limit: int = BUDGET) -> DataFrame:
    """start and the whole brief as text or Markdown."""
    entry = F.col("text")
    if how == "markdown":
        lead = F.when(F.col("part") == "ref", F.lit("# ")).otherwise(F.lit("### "))
        block = F.concat(lead, F.col("id"), F.lit(" "), F.col("title"), F.lit("\n\n"), F.col("text"), F.when(F.col("excerpt") != "", F.concat(F.lit("\n\n"), F.col("excerpt"))).otherwise(""))
        head = F.concat(F.lit("## "), F.initcap("part"))
    else:
        block = F.concat(F.lit("  "), entry, F.when(F.col("excerpt") != "", F.concat(F.lit("\n"), indented(F.col("excerpt"), "    "))).otherwise(""))
        head = F.col("part")
    joint = "\n\n" if how == "markdown" else "\n"
    groups = told.withColumn("block", block).groupBy("start", "part").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"]), joint).alias("blocks"))
    whole = groups.withColumn("piece", F.when((F.col("part") == "ref") & F.lit(how == "markdown"), F.col("blocks")).otherwise(F.concat(head, F.lit(joint), F.col("blocks"))))
    text = whole.groupBy("start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"))
    spent = budgets(told, limit)
    line = F.format_string("\n\nbudget: %d tokens, %d used, %d without an excerpt", F.col("limit"), F.col("used"), F.col("degraded"))
    return text.join(spent, "start").select("start", F.concat("text", F.when(F.col("degraded") > 0, line).otherwise("")).alias("text"))


def brief_json(told: DataFrame, limit: int = BUDGET) -> DataFrame:
    """start and the whole brief as a JSON object."""
    one = F.struct("id", "title", "status", "path", "relation", F.when(F.col("excerpt") != "", F.col("excerpt")).alias("excerpt"))
    listed = told.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("seq", "part", one.alias("entry")))).alias("all"))

    def part(name: str) -> Column:
        return F.transform(F.filter("all", lambda x: x["part"] == name), lambda x: x["entry"])

    shape = F.struct(part("ref")[0].alias("ref"), *(part(n).alias(n.replace(" ", "_")) for n in GROUPS[1:]), F.struct("limit", "used", "degraded").alias("budget"))
    return listed.join(budgets(told, limit), "start").select("start", F.to_json(shape).alias("text"))
