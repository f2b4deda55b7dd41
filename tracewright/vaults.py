"""The driver's tables as Markdown documents, and as a corpus of the specification preset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.corpus import Corpus
from tracewright.plans.config import presets, read
from tracewright.sources import markdown
from tracewright.views import DAY, day, numbered, tables

#: Records of customers: by the key's remainder, what is wrong with each document.
RECORD_SECTIONS = {"preset": "adr", "sections": ["Context", "Decision|Outcome", {"heading": "Effects", "when": {"status": "superseded"}}], "ordered_sections": True}


def padded(key: Column) -> Column:
    """At least six digits; a longer number is whole, or several documents would share a name."""
    digits = key.cast("string")
    return F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


def six(text: str) -> Column:
    """A name or identity of such a document as the SQL writes it, with the first six digits of a longer number."""
    return F.regexp_replace(text, r"(/|P-|x)([0-9]{6})[0-9]+(?=\.|-|$)", "$1$2").alias(text)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, kind and content of one Markdown file for each customer, and a copy of some."""
    k = F.col("c_custkey")
    rest = lambda n: k % n
    status = F.when(rest(10) == 3, F.concat(F.lit("superseded by "), padded(k + 1))).when(rest(50) == 29, "decided").otherwise("accepted")
    keys = F.when(rest(20) == 4, F.concat(F.lit("supersedes: ["), padded(k - 1), F.lit("]\n"))).when(rest(100) == 33, F.concat(F.lit("supersedes: ["), padded(k + 1), F.lit("]\n")))
    keys = keys.when(rest(50) == 21, "supersedes: []\n").when(rest(50) == 22, "supersedes: [see 1]\n").when(rest(50) == 27, "depends-on: [9999999]\n").when(rest(50) == 31, "retracts: [{from: 1, edge: supersedes, to: 2}]\n").otherwise("")
    block = F.concat(F.lit("---\ntitle: "), F.col("c_mktsegment"), F.lit("\nstatus: "), status, F.lit("\n"), keys, F.lit("---\n"))
    head = F.when(rest(50) == 13, "").when(rest(50) == 17, "---\ntitle: [\n---\n").otherwise(block)
    body = F.when(rest(50) == 37, "## Decision\n## Context\n").when(rest(50) == 39, "## Context\n").otherwise("## Context\n\nSee [[1]].\n\n## Outcome:\n")
    name = F.when(rest(50) == 7, F.concat(F.lit("notes-"), k.cast("string"), F.lit(".md"))).otherwise(F.concat(padded(k), F.lit("-a.md")))
    own = tables(spark, sf_dir)("customer").select(k, name.alias("name"), F.concat(head, body).alias("text"))
    copies = own.where(rest(50) == 11).select("c_custkey", F.concat(padded(k), F.lit("-b.md")).alias("name"), "text")
    return own.unionByName(copies).select(F.concat(F.lit("docs/adr/"), "name").alias("path"), F.lit("document").alias("kind"), F.encode("text", "UTF-8").alias("content"))


def record_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return markdown.build(records(spark, sf_dir), read(RECORD_SECTIONS), DAY)


#: A corpus of kinds: parts are clauses of a closed kind, suppliers topics.
KINDS = {
    "preset": "adr",
    "kinds": {
        "clause": {"dir": "clauses", "id": r"P-\d{6,}", "status_values": ["accepted"], "closed": True, "append_only": True, "fields": {"level": {"one_of": ["low", "high"], "required": True}}},
        "topic": {"dir": "topics", "id": r"topic/\d+"},
    },
    "edges": [{"name": "about", "from": ["clause"], "to": ["topic"], "inverse": "told_by", "attrs": {"weight": {"type": "number"}}}, {"name": "needs", "from": ["clause"], "to": ["clause"]}],
    "derived_edges": [],
    "rules": [],
    "projections": [{"name": "high", "when": {"attr": {"level": {"eq": "high"}}}}],
    "binding": "high",
}


def kind_files(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """path, kind and content of one file for each part and supplier; changed: as of a later state."""
    t = tables(spark, sf_dir)
    k = F.col("p_partkey")
    rest = lambda n: k % n
    said = F.when(rest(40) == 3, "").otherwise(F.concat(F.lit("id: P-"), padded(k), F.lit("\n")))
    level = F.when(rest(40) == 5, "").when(rest(40) == 6, "level: middle\n").otherwise(F.when(F.col("p_size") > 25, "level: high\n").otherwise("level: low\n"))
    extra = F.when(rest(40) == 8, "colour: red\n").when(rest(40) == 9, "kind: topic\n").otherwise("")
    about = F.when(rest(40) == 10, "about: [{ref: topic/1, weight: heavy}]\n").otherwise("about: [topic/1]\n")
    badly = F.concat(F.when(k - 1 > 99999, "0").otherwise(""), (k - 1).cast("string"))
    needs = F.when((rest(40) == 12) & (k > 12), F.concat(F.lit("needs: [P-"), badly, F.lit("]\n"))).otherwise("")
    body = F.lit("text\nmore\n")
    if changed:
        level = F.when(rest(40) == 20, "level: none\n").otherwise(level)
        body = F.when(rest(40) == 21, "text\nother\n").when(rest(40) == 22, "text\nmore\nand more\n").otherwise(body)
    text = F.concat(F.lit("---\n"), said, F.lit("status: accepted\n"), level, extra, about, needs, F.lit("---\n"), body)
    parts = t("part").select(k, F.concat(F.lit("clauses/"), F.when(rest(40) == 3, F.lit("x")).otherwise(F.lit("P-")), padded(k), F.lit(".md")).alias("path"), F.lit("clause").alias("kind"), F.encode(text, "UTF-8").alias("content"))
    if changed:
        parts = parts.where(rest(40) != 23)
    n = F.col("s_suppkey")
    told = F.when(n == 2, "told_by: [P-000001]\n").otherwise("")
    topic = F.concat(F.lit("---\nid: topic/"), n.cast("string"), F.lit("\n"), told, F.lit("---\n"))
    topics = t("supplier").select(F.concat(F.lit("topics/"), n.cast("string"), F.lit(".md")).alias("path"), F.lit("topic").alias("kind"), F.encode(topic, "UTF-8").alias("content"))
    return parts.drop("p_partkey").unionByName(topics)


def kind_config():
    return read(KINDS)


NODE_KEYS = ("id", "kind", "status", "date", "modality", "in_force_from", "expires", "retired_on")


def spec_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clauses, lines as deviations, suppliers as premises, customers as tests, nations as incidents."""
    t = tables(spark, sf_dir)
    first = F.substring("o_orderpriority", 1, 1)
    modality = F.when(first == "1", "MUST").when(first == "2", "MUST_NOT").when(first == "3", "SHOULD").when(first == "4", "SHOULD_NOT").otherwise("MAY")
    status = F.when(F.col("o_orderstatus") == "O", "accepted").when(F.col("o_orderstatus") == "F", "superseded").otherwise("trial")
    none = F.lit(None).cast("string")
    rows = [
        t("orders").select(numbered(F.col("o_orderkey")).alias("id"), F.lit("clause").alias("kind"), status.alias("status"), day("o_orderdate").alias("date"), modality.alias("modality"), day("o_orderdate").alias("in_force_from"), none.alias("expires"), none.alias("retired_on")),
        t("lineitem").select(F.concat(F.lit("dev-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("deviation"), F.when(F.col("l_returnflag") == "R", "resolved").otherwise("accepted"), F.lit("1992-01-01"), none, none, F.when(F.col("l_returnflag") == "A", "1995-01-01"), none),
        t("supplier").select(F.concat(F.lit("premise/"), F.col("s_suppkey").cast("string")), F.lit("premise"), F.lit("accepted"), F.lit("1992-01-01"), none, none, none, F.when(F.col("s_acctbal") < 0, "1995-01-01")),
        t("customer").select(F.concat(F.lit("conform/"), F.col("c_custkey").cast("string")), F.lit("conform"), F.lit(""), none, none, none, none, none),
        t("nation").select(F.concat(F.lit("pm-"), F.col("n_nationkey").cast("string")), F.lit("pm"), F.lit("published"), none, none, none, none, none),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    values = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c in NODE_KEYS[1:]))))
    return every.distinct().select("id", "kind", F.concat("kind", F.lit("/"), "id", F.lit(".md")).alias("path"), F.lit("").alias("title"), "status", "date", F.lit(1).alias("line"), values.alias("scalars"), F.create_map().cast("map<string,array<string>>").alias("lists"), F.create_map().cast("map<string,int>").alias("key_lines"))


def spec_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright import views

    own = views.edges(spark, sf_dir).where("type IN ('supersedes', 'interop', 'enforces')").select("src", "dst", "type")
    t = tables(spark, sf_dir)
    order = numbered(F.col("l_orderkey"))
    lines = t("lineitem")
    parts = [
        lines.select(F.concat(F.lit("dev-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("src"), order.alias("dst"), F.lit("deviates-from").alias("type")),
        lines.where("l_linenumber = 1").select(order, F.concat(F.lit("premise/"), F.col("l_suppkey").cast("string")), F.lit("premise")),
        t("orders").where("o_totalprice > 100000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(numbered(F.col("o_orderkey")), F.concat(F.lit("pm-"), F.col("c_nationkey").cast("string")), F.lit("counterexample")),
    ]
    for p in parts:
        own = own.union(p)
    return own.distinct().select("*", F.lit("structured").alias("origin"), F.create_map().cast("map<string,string>").alias("attrs"))


def spec_corpus(spark: SparkSession, sf_dir: str, as_of: str = DAY) -> Corpus:
    return Corpus(spec_nodes(spark, sf_dir), spec_edges(spark, sf_dir), presets()["spec"], as_of).prepared()
