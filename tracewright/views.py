"""The driver's tables as a corpus: orders are clauses, parts topics, suppliers principles, customers tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.corpus import Corpus
from tracewright.plans.config import Config, read

DAY = "1996-06-30"

CONFIG = {
    "status_values": ["accepted", "superseded"],
    "kinds": {
        "clause": {
            "id": r"\d{8}",
            "status_values": ["accepted", "superseded"],
            "period": {"from": "date", "until": "expires"},
            "fields": {"tier": {"required": True, "one_of": ["Gold", "bronze"]}, "tags": {"type": "list", "min_items": 2}, "modality": {"deprecated": {"sunset": "1997-01-01", "replaced_by": "force"}}},
        },
        "topic": {"id": r"topic/\d+"},
        "principle": {"id": r"principle/\d+", "status_values": ["accepted"]},
        "conform": {"id": r"conform/\d+"},
    },
    "edges": [
        {"name": "supersedes", "acyclic": True, "from": ["clause"], "to": ["clause"], "max_inbound": 1, "attrs": {"gap": {"required": True, "type": "number"}, "reason": {"one_of": ["cheaper"]}}},
        {"name": "about", "from": ["clause"], "to": ["topic"], "min_outbound": 4},
        {"name": "enforces", "from": ["conform"], "to": ["clause"], "target": {"attr": {"status": {"eq": "accepted"}}, "leaf_of": "supersedes"}},
        {"name": "rationale", "from": ["clause"], "to": ["principle"]},
        {"name": "interop", "from": ["clause"], "to": ["clause"], "acyclic": True},
        {"name": "excepts", "from": ["clause"], "to": ["principle"]},
        {"name": "depends-on", "from": ["clause"], "to": ["clause"], "target": {"attr": {"in_force": {"eq": "true"}}}},
    ],
    "projections": [
        {"name": "accepted_unsuperseded", "when": {"attr": {"status": {"eq": "accepted"}, "in_force": {"eq": "true"}}, "not": {"any_of": [{"via_inbound": {"edge": "supersedes", "attr": {"status": {"eq": "accepted"}, "in_force": {"eq": "true"}}}}, {"via_inbound": {"edge": "supersedes", "attr": {"status": {"eq": "superseded"}}}}]}}},
        {"name": "enforced", "when": {"inbound": "enforces"}},
        {"name": "strong", "any_of": [{"attr": {"enforced": {"eq": "true"}, "modality": {"eq": "must"}}}, {"attr": {"tier": {"eq": "gold"}}}]},
    ],
    "binding": "accepted_unsuperseded",
    "rules": [
        {"name": "status_drift", "severity": "error", "when": {"via_inbound": {"edge": "supersedes", "attr": {"status": {"subset_of": ["accepted", "superseded"]}}}, "attr": {"status": {"not": "superseded"}, "kind": {"eq": "clause"}}}, "message": "drifts"},
        {"name": "superseded_orphan", "severity": "warn", "when": {"not_inbound": "supersedes", "attr": {"status": {"eq": "superseded"}}}, "message": "is alone"},
        {"name": "orphan_must", "severity": "error", "when": {"any_of": [{"attr": {"modality": {"eq": "MUST"}}}, {"attr": {"modality": {"eq": "MUST_NOT"}}}], "attr": {"status": {"eq": "accepted"}}, "not_inbound": "enforces"}, "message": "is not enforced"},
        {"name": "weak_base", "severity": "warn", "when": {"via": {"edge": "depends-on", "attr": {"strong": {"eq": "false"}}}, "attr": {"strong": {"eq": "true"}}}, "message": "rests on a weak clause"},
    ],
    "path_constraints": [{"name": "chain", "path": ["supersedes", "depends-on"], "subset_of": ["depends-on"]}, {"name": "apart", "path": ["excepts"]}],
    "acyclic_union": ["supersedes", "depends-on"],
    "references": {"dangling": "warn"},
}


def config() -> Config:
    return read(CONFIG, Config())


def numbered(key: Column) -> Column:
    return F.lpad(key.cast("string"), 8, "0")


def day(at: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("tags"), F.max("l_shipdate").alias("shipped"))
    o = t("orders").join(lines, "o_orderkey", "left")
    status = F.when(F.col("o_orderstatus") == "O", "accepted").when(F.col("o_orderstatus") == "F", "superseded").otherwise("proposed")
    first = F.substring("o_orderpriority", 1, 1)
    modality = F.when(first == "1", "MUST").when(first == "2", "MUST_NOT").when(first == "3", "SHOULD").when(first == "4", "SHOULD_NOT").otherwise("MAY")
    tier = F.when(F.col("o_totalprice") > 200000, "Gold").when(F.col("o_totalprice") >= 50000, "silver")
    expires = F.when((first == "4") & (F.col("o_orderstatus") == "P"), "soon").when(first == "5", day("shipped"))
    values = {"status": status, "modality": modality, "tier": tier, "expires": expires}
    pairs = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in {**values, "kind": F.lit("clause")}.items())))
    scalars = F.map_from_entries(pairs)
    lists = F.when(F.col("tags").isNotNull(), F.create_map(F.lit("tags"), "tags")).otherwise(F.create_map().cast("map<string,array<string>>"))
    keys = F.concat(F.map_keys(scalars), F.map_keys(lists))
    key_lines = F.map_from_arrays(keys, F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: (i + 1).cast("int")))
    clause = o.select(numbered(F.col("o_orderkey")).alias("id"), F.lit("clause").alias("kind"), F.concat(F.lit("clauses/"), numbered(F.col("o_orderkey")), F.lit(".md")).alias("path"), F.lit("clause").alias("title"), status.alias("status"), day("o_orderdate").alias("date"), F.lit(1).alias("line"), scalars.alias("scalars"), lists.alias("lists"), key_lines.alias("key_lines"))

    def plain(df: DataFrame, kind: str, key: str, status: Column) -> DataFrame:
        i = F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))
        return df.select(i.alias("id"), F.lit(kind).alias("kind"), F.concat(i, F.lit(".md")).alias("path"), F.lit(kind).alias("title"), status.alias("status"), F.lit(None).cast("string").alias("date"), F.lit(1).alias("line"), F.create_map(F.lit("kind"), F.lit(kind), F.lit("status"), status).alias("scalars"), F.create_map().cast("map<string,array<string>>").alias("lists"), F.create_map().cast("map<string,int>").alias("key_lines"))

    none = F.lit("")
    return clause.unionByName(plain(t("part"), "topic", "p_partkey", none)).unionByName(plain(t("supplier").where("s_acctbal > 0"), "principle", "s_suppkey", F.lit("accepted"))).unionByName(plain(t("customer"), "conform", "c_custkey", none))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    mine = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    o = o.select("*", F.lag("o_orderkey").over(mine).alias("before"), F.lag("o_totalprice").over(mine).alias("price_before"), F.lag("o_orderdate").over(mine).alias("day_before"), F.lead("o_orderkey").over(mine).alias("after"), F.first("o_orderkey").over(mine).alias("start"), F.first("o_orderkey").over(best).alias("top"))
    me = numbered(F.col("o_orderkey"))
    gap = F.datediff("o_orderdate", "day_before").cast("string")
    attrs = F.when(F.col("o_totalprice") < F.col("price_before"), F.create_map(F.lit("gap"), gap, F.lit("reason"), F.lit("cheaper"))).when(F.col("o_orderstatus") == "P", F.create_map(F.lit("note"), gap)).otherwise(F.create_map(F.lit("gap"), gap, F.lit("reason"), F.lit("dearer")))
    none = F.create_map().cast("map<string,string>")

    def of(df: DataFrame, kind: str, src: Column, dst: Column, attrs: Column = none) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("structured").alias("origin"), attrs.alias("attrs"))

    lines = t("lineitem")
    order = numbered(F.col("l_orderkey"))
    parts = [
        of(o.where("before IS NOT NULL"), "supersedes", me, numbered(F.col("before")), attrs),
        of(lines.select("l_orderkey", "l_partkey").distinct(), "about", order, F.concat(F.lit("topic/"), F.col("l_partkey").cast("string"))),
        of(lines.select("l_orderkey", "l_suppkey").distinct(), "rationale", order, F.concat(F.lit("principle/"), F.col("l_suppkey").cast("string"))),
        of(o.where("o_totalprice > 150000"), "enforces", F.concat(F.lit("conform/"), F.col("o_custkey").cast("string")), me),
        of(o.where("c_mktsegment = 'BUILDING'"), "interop", me, numbered(F.coalesce("after", "start"))),
        of(o.where("price_before > o_totalprice"), "excepts", me, numbered(F.col("before"))),
        of(o.where("top <> o_orderkey"), "depends-on", me, numbered(F.col("top"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order mentions the supplier and the part of its most expensive line."""
    dear = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    lines = tables(spark, sf_dir)("lineitem").withColumn("nth", F.row_number().over(dear)).where("nth = 1")
    both = F.explode(F.array(F.concat(F.lit("principle/"), F.col("l_suppkey").cast("string")), F.concat(F.lit("topic/"), F.col("l_partkey").cast("string"))))
    return lines.select(numbered(F.col("l_orderkey")).alias("src"), both.alias("dst"))


def corpus(spark: SparkSession, sf_dir: str, as_of: str = DAY) -> Corpus:
    return Corpus(nodes(spark, sf_dir), edges(spark, sf_dir), config(), as_of, refs=refs(spark, sf_dir))


SQL = f"""
WITH RECURSIVE lines AS (
  SELECT l_orderkey AS o_orderkey, list_sort(list(DISTINCT l_returnflag)) AS tags, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1
), clauses AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id, 'clause' AS kind,
    CASE o_orderstatus WHEN 'O' THEN 'accepted' WHEN 'F' THEN 'superseded' ELSE 'proposed' END AS status,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MUST' WHEN '2' THEN 'MUST_NOT' WHEN '3' THEN 'SHOULD' WHEN '4' THEN 'SHOULD_NOT' ELSE 'MAY' END AS modality,
    CASE WHEN o_totalprice > 200000 THEN 'Gold' WHEN o_totalprice >= 50000 THEN 'silver' END AS tier,
    CASE WHEN substr(o_orderpriority, 1, 1) = '4' AND o_orderstatus = 'P' THEN 'soon'
      WHEN substr(o_orderpriority, 1, 1) = '5' THEN strftime(shipped, '%Y-%m-%d') END AS expires,
    strftime(o_orderdate, '%Y-%m-%d') AS day, tags
  FROM orders LEFT JOIN lines USING (o_orderkey)
), nodes AS (
  SELECT * FROM clauses
  UNION ALL SELECT 'topic/' || p_partkey, 'topic', '', NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'principle/' || s_suppkey, 'principle', 'accepted', NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 'conform/' || c_custkey, 'conform', '', NULL, NULL, NULL, NULL, NULL FROM customer
), o AS (
  SELECT orders.*, c_mktsegment, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS me,
    lag(o_orderkey) OVER mine AS before, lag(o_totalprice) OVER mine AS price_before, lag(o_orderdate) OVER mine AS day_before,
    lead(o_orderkey) OVER mine AS after, first_value(o_orderkey) OVER mine AS start, first_value(o_orderkey) OVER best AS top
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  WINDOW mine AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), best AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
), edges AS (
  SELECT me AS src, lpad(CAST(before AS VARCHAR), 8, '0') AS dst, 'supersedes' AS type,
    CASE WHEN o_totalprice < price_before OR o_orderstatus <> 'P' THEN datediff('day', day_before, o_orderdate) END AS gap,
    CASE WHEN o_totalprice < price_before THEN 'cheaper' WHEN o_orderstatus <> 'P' THEN 'dearer' END AS reason
  FROM o WHERE before IS NOT NULL
  UNION ALL SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 8, '0'), 'topic/' || l_partkey, 'about', NULL, NULL FROM lineitem
  UNION ALL SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 8, '0'), 'principle/' || l_suppkey, 'rationale', NULL, NULL FROM lineitem
  UNION ALL SELECT 'conform/' || o_custkey, me, 'enforces', NULL, NULL FROM o WHERE o_totalprice > 150000
  UNION ALL SELECT me, lpad(CAST(coalesce(after, start) AS VARCHAR), 8, '0'), 'interop', NULL, NULL FROM o WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT me, lpad(CAST(before AS VARCHAR), 8, '0'), 'excepts', NULL, NULL FROM o WHERE price_before > o_totalprice
  UNION ALL SELECT me, lpad(CAST(top AS VARCHAR), 8, '0'), 'depends-on', NULL, NULL FROM o WHERE top <> o_orderkey
), dear AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS nth FROM lineitem
), refs AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS src, 'principle/' || l_suppkey AS dst FROM dear WHERE nth = 1
  UNION ALL SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0'), 'topic/' || l_partkey FROM dear WHERE nth = 1
), ends AS (
  SELECT e.dst AS id, min(n.day) AS derived_until FROM edges e JOIN nodes n ON n.id = e.src AND n.status = 'accepted'
  WHERE e.type = 'supersedes' GROUP BY 1
), dated AS (
  SELECT *, coalesce(explicit_until, derived_until) AS until_day,
    kind <> 'clause' OR (day <= '{{day}}' AND coalesce(coalesce(explicit_until, derived_until) > '{{day}}', true)) AS in_force
  FROM (SELECT nodes.*, CASE WHEN expires <> 'soon' THEN expires END AS explicit_until, derived_until FROM nodes LEFT JOIN ends USING (id))
), weighing AS (
  SELECT e.* FROM edges e LEFT JOIN dated d ON d.id = e.src WHERE e.type = 'supersedes' OR coalesce(d.in_force, true)
), bound AS (
  SELECT * FROM dated d WHERE status = 'accepted' AND in_force AND NOT EXISTS (
    SELECT 1 FROM weighing w JOIN dated s ON s.id = w.src
    WHERE w.type = 'supersedes' AND w.dst = d.id AND (s.status = 'superseded' OR (s.status = 'accepted' AND s.in_force)))
), judged AS (
  SELECT *, enforced AND coalesce(modality = 'MUST', false) OR coalesce(tier = 'Gold', false) AS strong
  FROM (SELECT *, id IN (SELECT dst FROM weighing WHERE type = 'enforces') AS enforced FROM dated)
)
"""


def sql(body: str, as_of: str = DAY, more: str = "") -> str:
    """A query in DuckDB's dialect over the same corpus, with further common tables."""
    return SQL.replace("{day}", as_of).rstrip() + (", " + more if more else "") + "\n" + body
