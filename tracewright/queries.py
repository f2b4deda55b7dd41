"""Queries over the driver's tables for each group of operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import checks, graph, stats
from tracewright.plans.config import AttrTest, Condition
from tracewright.views import corpus, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **how):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **how)
        return f

    return put


@query("binding", "SELECT id, modality FROM bound")
def binding(spark, sf_dir):
    return corpus(spark, sf_dir).binding.select("id", F.try_element_at("scalars", F.lit("modality")).alias("modality"))


@query("binding_earlier", "SELECT id, modality FROM bound", as_of="1994-03-01")
def binding_earlier(spark, sf_dir):
    return corpus(spark, sf_dir, "1994-03-01").binding.select("id", F.try_element_at("scalars", F.lit("modality")).alias("modality"))


@query("periods", "SELECT id, derived_until, until_day, in_force FROM dated")
def periods(spark, sf_dir):
    return corpus(spark, sf_dir).dated.select("id", "derived_until", "until_day", "in_force")


for op, value, condition in (
    ("eq", "gold", "coalesce(lower(tier) = 'gold', false)"),
    ("not", "gold", "coalesce(lower(tier) <> 'gold', true)"),
):

    @query(f"where_{op}", f"SELECT id FROM nodes WHERE {condition}")
    def where_scalar(spark, sf_dir, op=op, value=value):
        return corpus(spark, sf_dir).where({"tier": AttrTest(op, value)}).select("id")


for op, value, condition in (
    ("contains", "a", "coalesce(list_contains(tags, 'A'), false)"),
    ("not_contains", "a", "NOT coalesce(list_contains(tags, 'A'), false)"),
    ("subset_of", ("a", "N"), "coalesce(len([x FOR x IN tags IF x NOT IN ('A', 'N')]) = 0, false)"),
):

    @query(f"where_{op}", f"SELECT id FROM nodes WHERE {condition}")
    def where_list(spark, sf_dir, op=op, value=value):
        return corpus(spark, sf_dir).where({"tags": AttrTest(op, value)}).select("id")


def met(spark, sf_dir, raw: dict) -> DataFrame:
    return corpus(spark, sf_dir).holding(met=Condition.read(raw)).where("met").select("id")


@query("condition_degree", "SELECT n.id FROM nodes n JOIN (SELECT src, count(*) AS k FROM weighing WHERE type = 'about' GROUP BY 1) ON src = n.id WHERE k BETWEEN 3 AND 5")
def condition_degree(spark, sf_dir):
    return met(spark, sf_dir, {"outbound": {"edge": "about", "min": 3, "max": 5}})


@query("condition_not_degree", "SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM weighing WHERE type = 'enforces') AND id NOT IN (SELECT src FROM weighing WHERE type = 'interop')")
def condition_not_degree(spark, sf_dir):
    return met(spark, sf_dir, {"not_inbound": "enforces", "not_outbound": "interop"})


@query("condition_via", "SELECT DISTINCT w.src AS id FROM weighing w JOIN nodes s ON s.id = w.src JOIN dated d ON d.id = w.dst WHERE w.type = 'depends-on' AND NOT d.in_force AND coalesce(d.tier = 'Gold', false)")
def condition_via(spark, sf_dir):
    return met(spark, sf_dir, {"via": {"edge": "depends-on", "attr": {"in_force": {"eq": "false"}, "tier": {"eq": "gold"}}}})


@query("condition_nested", """SELECT d.id FROM dated d WHERE coalesce(modality = 'MAY', false) AND NOT (
  EXISTS (SELECT 1 FROM weighing w JOIN dated s ON s.id = w.src WHERE w.type = 'supersedes' AND w.dst = d.id AND coalesce(s.tier <> 'Gold', true))
  OR (status = 'proposed' AND NOT in_force))""")
def condition_nested(spark, sf_dir):
    return met(spark, sf_dir, {"attr": {"modality": {"eq": "may"}}, "not": {"any_of": [{"via_inbound": {"edge": "supersedes", "attr": {"tier": {"not": "Gold"}}}}, {"attr": {"status": {"eq": "proposed"}, "in_force": {"eq": "false"}}}]}})


@query("projections", "SELECT id, enforced AS is_enforced, strong AS is_strong, id IN (SELECT id FROM bound) AS is_accepted_unsuperseded FROM judged")
def projections(spark, sf_dir):
    return corpus(spark, sf_dir).frame.select("id", "is_enforced", "is_strong", "is_accepted_unsuperseded")


RULES = """rule_hits AS (
  SELECT 'error' AS severity, 'status_drift' AS rule, id FROM judged d WHERE kind = 'clause' AND status <> 'superseded' AND EXISTS (
    SELECT 1 FROM weighing w JOIN nodes s ON s.id = w.src WHERE w.type = 'supersedes' AND w.dst = d.id AND s.status IN ('accepted', 'superseded'))
  UNION ALL SELECT 'warn', 'superseded_orphan', id FROM judged WHERE status = 'superseded' AND id NOT IN (SELECT dst FROM weighing WHERE type = 'supersedes')
  UNION ALL SELECT 'error', 'orphan_must', id FROM judged WHERE status = 'accepted' AND coalesce(modality IN ('MUST', 'MUST_NOT'), false) AND NOT enforced
  UNION ALL SELECT 'warn', 'weak_base', id FROM judged d WHERE strong AND EXISTS (
    SELECT 1 FROM weighing w JOIN judged t ON t.id = w.dst WHERE w.type = 'depends-on' AND w.src = d.id AND NOT t.strong)
)"""


@query("rules", "SELECT severity, rule, id FROM rule_hits", more=RULES)
def rules(spark, sf_dir):
    return checks.rules(corpus(spark, sf_dir)).select("severity", "rule", "id")


@query("rule_firing", "SELECT rule, CAST(count(id) AS BIGINT) AS fired, (SELECT count(*) FROM nodes) AS total FROM (SELECT unnest(['status_drift', 'superseded_orphan', 'orphan_must', 'weak_base']) AS rule) LEFT JOIN rule_hits USING (rule) GROUP BY rule", more=RULES)
def rule_firing(spark, sf_dir):
    return stats.firing(corpus(spark, sf_dir)).select("rule", "fired", F.col("total").cast("long").alias("total"))


CHECK_SQL = {
    "dangling_ref": "SELECT 'error' AS severity, src AS id, type || ' leads to ' || dst || ', which is unknown' AS detail FROM edges WHERE dst NOT IN (SELECT id FROM nodes) AND src IN (SELECT id FROM nodes)",
    "unknown_status": "SELECT 'error' AS severity, id, 'has the unknown status ' || status AS detail FROM nodes WHERE kind = 'clause' AND status NOT IN ('accepted', 'superseded')",
    "unknown_field_value": "SELECT 'error' AS severity, id, 'tier is ' || tier || ', none of Gold, bronze' AS detail FROM nodes WHERE tier NOT IN ('Gold', 'bronze')",
    "missing_field": "SELECT 'error' AS severity, id, 'needs a value for tier' AS detail FROM nodes WHERE kind = 'clause' AND tier IS NULL UNION ALL SELECT 'error', id, 'tags needs 2 items' FROM nodes WHERE len(tags) < 2",
    "deprecated_field": "SELECT 'warn' AS severity, id, 'modality is retired; force takes its place' AS detail FROM nodes WHERE modality IS NOT NULL",
    "edge_kind_mismatch": "SELECT 'error' AS severity, src AS id, 'excepts has an end ' || dst || ' of kind clause' AS detail FROM edges WHERE type = 'excepts'",
    "edge_attr_unknown": "SELECT 'error' AS severity, src AS id, 'supersedes to ' || dst || ': attribute note' AS detail FROM edges WHERE type = 'supersedes' AND gap IS NULL",
    "edge_attr_missing": "SELECT 'error' AS severity, src AS id, 'supersedes to ' || dst || ': attribute gap' AS detail FROM edges WHERE type = 'supersedes' AND gap IS NULL",
    "edge_attr_invalid": "SELECT 'error' AS severity, src AS id, 'supersedes to ' || dst || ': attribute reason' AS detail FROM edges WHERE type = 'supersedes' AND reason = 'dearer'",
    "cardinality": "SELECT 'error' AS severity, id, 'about: ' || coalesce(k, 0) || ' where at least 4 fit' AS detail FROM clauses LEFT JOIN (SELECT src, count(*) AS k FROM edges WHERE type = 'about' GROUP BY 1) ON src = id WHERE coalesce(k, 0) < 4",
    "stale_target": """SELECT 'error' AS severity, e.src AS id, e.type || ' leads to ' || e.dst || ', which it may not' AS detail FROM edges e JOIN dated t ON t.id = e.dst JOIN dated s ON s.id = e.src
      WHERE s.in_force AND (e.type = 'depends-on' AND NOT t.in_force OR e.type = 'enforces' AND (t.status <> 'accepted' OR EXISTS (
        SELECT 1 FROM edges r JOIN dated q ON q.id = r.src WHERE r.type = 'supersedes' AND r.dst = t.id AND q.status = 'accepted' AND q.in_force)))""",
    "excepts_strict": "SELECT 'error' AS severity, e.src AS id, 'makes an exception to ' || e.dst || ', which allows none' AS detail FROM edges e JOIN clauses c ON c.id = e.dst WHERE e.type = 'excepts' AND c.modality IN ('MUST', 'MUST_NOT')",
    "period_invalid": "SELECT 'error' AS severity, id, 'expires is no day: soon' AS detail FROM nodes WHERE expires = 'soon' UNION ALL SELECT 'error', id, 'ends on ' || explicit_until || ', before it begins on ' || day FROM dated WHERE explicit_until < day",
    "period_conflict": "SELECT 'error' AS severity, id, 'says that it ends on ' || explicit_until || '; its successor begins on ' || derived_until AS detail FROM dated WHERE explicit_until <> derived_until",
    "expired_deviation": "SELECT 'warn' AS severity, id, 'is still accepted, though it ended on ' || explicit_until AS detail FROM dated WHERE status = 'accepted' AND explicit_until <= '{day}'",
    "dangling_reference": "SELECT 'warn' AS severity, src AS id, 'links to ' || dst || ', which is unknown' AS detail FROM refs WHERE dst NOT IN (SELECT id FROM nodes)",
    "path_mismatch": """SELECT 'error' AS severity, src AS id, 'chain: reaches ' || string_agg(dst, ', ' ORDER BY dst) AS detail FROM (
        SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst AND b.type = 'depends-on' WHERE a.type = 'supersedes' EXCEPT SELECT src, dst FROM edges WHERE type = 'depends-on') GROUP BY src
      UNION ALL SELECT 'error', src, 'apart: reaches ' || string_agg(DISTINCT dst, ', ' ORDER BY dst) FROM edges WHERE type = 'excepts' GROUP BY src""",
    "modality_conflict": """SELECT 'error' AS severity, a AS id, ma || ' conflicts with ' || b || ' (' || mb || ') on ' || topics AS detail FROM pairs""",
}
PAIRS = """pairs AS (
  SELECT x.id AS a, y.id AS b, x.modality AS ma, y.modality AS mb, string_agg(DISTINCT p.dst, ', ' ORDER BY p.dst) AS topics
  FROM bound x JOIN edges p ON p.src = x.id AND p.type = 'about' JOIN edges q ON q.dst = p.dst AND q.type = 'about' JOIN bound y ON y.id = q.src
  WHERE x.id < y.id AND (x.modality IN ('MUST_NOT', 'SHOULD_NOT')) <> (y.modality IN ('MUST_NOT', 'SHOULD_NOT')) GROUP BY 1, 2, 3, 4
)"""

for rule, body in CHECK_SQL.items():

    @query(f"check_{rule}", body.replace("{day}", "1996-06-30"), more=PAIRS if rule == "modality_conflict" else "")
    def check(spark, sf_dir, rule=rule):
        return checks.CHECKS[rule](corpus(spark, sf_dir)).select("severity", "id", "detail")


@query("check_unmentioned_edge", "SELECT src AS id, dst AS other FROM edges e WHERE type = 'rationale' AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.src = e.src AND r.dst = e.dst)")
def check_unmentioned(spark, sf_dir):
    from dataclasses import replace

    c = corpus(spark, sf_dir)
    noted = tuple(replace(e, require_mention="warn") if e.name == "rationale" else e for e in c.cfg.edges)
    rows = checks.unmentioned_edge(replace(c, cfg=replace(c.cfg, edges=noted)))
    return rows.select("id", F.regexp_extract("detail", "^rationale to (.*) is not", 1).alias("other"))


@query("conflict_pairs", """SELECT a, b, CAST(len(string_split(topics, ', ')) AS INTEGER) AS n_topics, ma IN ('MUST', 'MUST_NOT') AND mb IN ('MUST', 'MUST_NOT') AS strong,
  CASE WHEN ma IN ('MUST', 'MUST_NOT') AND mb IN ('MUST', 'MUST_NOT') THEN NULL
    WHEN EXISTS (SELECT 1 FROM weighing w WHERE w.type = 'excepts' AND w.src = a AND w.dst = b) THEN a
    WHEN EXISTS (SELECT 1 FROM weighing w WHERE w.type = 'excepts' AND w.src = b AND w.dst = a) THEN b END AS defeater FROM pairs""", more=PAIRS)
def conflict_pairs(spark, sf_dir):
    return checks.modality_pairs(corpus(spark, sf_dir)).select("a", "b", F.size("topics").alias("n_topics"), "strong", "defeater")


CLOSURE = "reach AS (SELECT src, dst FROM edges WHERE type = '{type}' UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst AND e.type = '{type}')"


@query("closure", "SELECT src, dst FROM reach", more=CLOSURE.replace("{type}", "supersedes"))
def closure(spark, sf_dir):
    return graph.closure(graph.steps(corpus(spark, sf_dir).edges, ["supersedes"]))


@query("descendants", "SELECT src AS start, dst AS id FROM reach WHERE src <> dst AND src IN (SELECT id FROM bound)", more=CLOSURE.replace("{type}", "supersedes"))
def descendants(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return graph.descendants(c, c.binding.select("id"), ["supersedes"]).select("start", "id")


@query("ancestors", "SELECT dst AS start, src AS id FROM reach WHERE src <> dst AND dst IN (SELECT id FROM bound)", more=CLOSURE.replace("{type}", "supersedes"))
def ancestors(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return graph.ancestors(c, c.binding.select("id"), ["supersedes"]).select("start", "id")


@query("within_two", """SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM (
  SELECT e.src AS start, e.dst AS id, 1 AS depth FROM edges e WHERE e.type IN ('supersedes', 'depends-on')
  UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON b.src = a.dst AND b.type IN ('supersedes', 'depends-on') WHERE a.type IN ('supersedes', 'depends-on'))
  WHERE start <> id AND start IN (SELECT id FROM bound) GROUP BY 1, 2""")
def within_two(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return graph.descendants(c, c.binding.select("id"), ["supersedes", "depends-on"], depth=2).select("start", "id", "depth")


@query("cyclic", "SELECT DISTINCT src AS id FROM reach WHERE src = dst", more=CLOSURE.replace("{type}", "interop"))
def cyclic(spark, sf_dir):
    return graph.cyclic(graph.steps(corpus(spark, sf_dir).edges, ["interop"]))


@query("strong_components", "SELECT a.src AS id, min(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY 1", more=CLOSURE.replace("{type}", "interop"))
def strong_components(spark, sf_dir):
    return graph.strong_components(graph.steps(corpus(spark, sf_dir).edges, ["interop"]))


@query("check_cycle", "SELECT component AS id, CAST(count(*) + 1 AS INTEGER) AS length FROM (SELECT a.src AS id, min(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY 1) GROUP BY 1", more=CLOSURE.replace("{type}", "interop"))
def check_cycle(spark, sf_dir):
    rows = graph.cycle_paths(graph.steps(corpus(spark, sf_dir).edges, ["interop"]))
    return rows.select(F.element_at("path", 1).alias("id"), F.size("path").alias("length"))


@query("check_cycle_union", """SELECT 'interop' AS type, min(me) AS id FROM o WHERE c_mktsegment = 'BUILDING' GROUP BY o_custkey
UNION ALL SELECT 'supersedes + depends-on', min(a.me) FROM o a JOIN o b ON b.o_custkey = a.o_custkey AND b.o_orderkey = b.top
  AND (a.o_orderdate < b.o_orderdate OR (a.o_orderdate = b.o_orderdate AND a.o_orderkey <= b.o_orderkey)) GROUP BY a.o_custkey HAVING count(*) > 1""")
def check_cycle_union(spark, sf_dir):
    """Of a customer's orders, those up to the most expensive one are on cycles of the two types, on none of a single one."""
    return checks.cycle(corpus(spark, sf_dir)).select(F.substring_index("detail", " goes in", 1).alias("type"), "id")


LINEAGE = """lead AS (
  SELECT id FROM dated WHERE status = 'accepted' AND in_force
  UNION SELECT e.dst FROM lead l JOIN edges e ON e.type = 'supersedes' AND e.src = l.id JOIN nodes n ON n.id = e.dst AND n.status = 'superseded'
), ways AS (
  SELECT id AS start, id FROM clauses
  UNION SELECT w.start, e.src FROM ways w JOIN edges e ON e.type = 'supersedes' AND e.dst = w.id JOIN lead l ON l.id = e.src
)"""


@query("resolve", "SELECT start, id FROM ways w WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN lead l ON l.id = e.src WHERE e.type = 'supersedes' AND e.dst = w.id)", more=LINEAGE)
def resolve(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return graph.resolve(c, c.nodes.where("kind = 'clause'").select("id"))[0]


@query("resolve_pending", """SELECT DISTINCT w.start, e.src AS id, w.id AS predecessor, CASE WHEN s.status = 'accepted' AND NOT s.in_force THEN 'not in force' ELSE s.status END AS reason
  FROM ways w JOIN edges e ON e.type = 'supersedes' AND e.dst = w.id JOIN dated s ON s.id = e.src WHERE e.src NOT IN (SELECT id FROM lead)""", more=LINEAGE)
def resolve_pending(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return graph.resolve(c, c.nodes.where("kind = 'clause'").select("id"))[1]


@query("neighbours", """SELECT start, id, max(layer) AS layer FROM (
  SELECT src AS start, dst AS id, 'typed' AS layer FROM edges UNION ALL SELECT dst, src, 'typed' FROM edges
  UNION ALL SELECT src, dst, 'reference' FROM refs UNION ALL SELECT dst, src, 'reference' FROM refs)
  WHERE start <> id AND start IN (SELECT id FROM bound) AND id IN (SELECT id FROM nodes) GROUP BY 1, 2""")
def neighbours(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return graph.neighbours(c, c.binding.select("id"))


@query("edge_counts", "SELECT type, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY 1")
def edge_counts(spark, sf_dir):
    return stats.edge_counts(corpus(spark, sf_dir)).select("type", "n")


@query("orphans", "SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS BIGINT) AS orphans FROM nodes")
def orphans(spark, sf_dir):
    return stats.orphans(corpus(spark, sf_dir)).select("documents", "orphans")


@query("depth_histogram", """SELECT CAST(coalesce(d, 0) AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS n FROM nodes
  LEFT JOIN (SELECT src, count(DISTINCT dst) AS d FROM reach GROUP BY 1) ON src = id GROUP BY 1""", more=CLOSURE.replace("{type}", "supersedes"))
def depth_histogram(spark, sf_dir):
    return stats.depth_histogram(corpus(spark, sf_dir))


@query("most_referenced", "SELECT dst AS id, CAST(count(*) AS BIGINT) AS n FROM refs WHERE dst IN (SELECT id FROM nodes) GROUP BY 1 ORDER BY n DESC, id LIMIT 10")
def most_referenced(spark, sf_dir):
    return stats.most_referenced(corpus(spark, sf_dir))


@query("clauses_by_topic", "SELECT n.id, CAST(count(e.src) AS BIGINT) AS n FROM nodes n LEFT JOIN edges e ON e.dst = n.id AND e.type = 'about' WHERE kind = 'topic' GROUP BY 1")
def clauses_by_topic(spark, sf_dir):
    return stats.clauses_by_topic(corpus(spark, sf_dir))


@query("modalities", "SELECT modality, CAST(count(*) AS BIGINT) AS n FROM clauses GROUP BY 1")
def modalities(spark, sf_dir):
    return stats.modalities(corpus(spark, sf_dir))


@query("suppressed_conflicts", """SELECT CAST(count(*) FILTER (WHERE weak AND gone) AS BIGINT) AS suppressed, CAST(count(*) FILTER (WHERE NOT (weak AND gone)) AS BIGINT) AS open FROM (
  SELECT NOT (ma IN ('MUST', 'MUST_NOT') AND mb IN ('MUST', 'MUST_NOT')) AS weak,
    EXISTS (SELECT 1 FROM weighing w WHERE w.type = 'excepts' AND (w.src = a AND w.dst = b OR w.src = b AND w.dst = a)) AS gone FROM pairs)""", more=PAIRS)
def suppressed_conflicts(spark, sf_dir):
    return stats.suppressed_conflicts(corpus(spark, sf_dir))


@query("field_usage", """SELECT key, CAST(count(*) AS BIGINT) AS documents, max(day) AS last_change, key = 'modality' AS deprecated FROM (
  SELECT unnest(['status', 'modality', 'kind']) AS key, day FROM clauses UNION ALL SELECT 'tier', day FROM clauses WHERE tier IS NOT NULL
  UNION ALL SELECT 'expires', day FROM clauses WHERE expires IS NOT NULL UNION ALL SELECT 'tags', day FROM clauses WHERE tags IS NOT NULL) GROUP BY 1""")
def field_usage(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.field_usage(c, c.nodes.select("path", F.col("date").alias("day")))


def earlier(spark, sf_dir):
    """The state before the orders of 1996: without them, and with proposals for what was accepted in 1995."""
    from dataclasses import replace

    c = corpus(spark, sf_dir)
    late = F.col("date") >= "1996-01-01"
    changed = (F.col("date") >= "1995-01-01") & (F.col("status") == "accepted")
    nodes = c.nodes.where(~F.coalesce(late, F.lit(False))).withColumn("status", F.when(changed, "proposed").otherwise(F.col("status")))
    kept = nodes.select("id")
    edges = c.edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "type", "origin", "attrs")
    return replace(c, nodes=nodes, edges=edges)


BEFORE = """before AS (
  SELECT id, CASE WHEN coalesce(day >= '1995-01-01', false) AND status = 'accepted' THEN 'proposed' ELSE status END AS status FROM nodes WHERE NOT coalesce(day >= '1996-01-01', false)
)"""


@query("diff_documents", """SELECT CASE WHEN b.id IS NULL THEN 'added' ELSE 'status' END AS op, n.id, b.status AS before, n.status AS after
  FROM nodes n LEFT JOIN before b USING (id) WHERE b.id IS NULL OR b.status <> n.status""", more=BEFORE)
def diff_documents(spark, sf_dir):
    from tracewright.operators import history

    return history.document_changes(earlier(spark, sf_dir), corpus(spark, sf_dir))


@query("diff_edges", "SELECT 'added' AS op, type, src, dst FROM edges WHERE src NOT IN (SELECT id FROM before)", more=BEFORE)
def diff_edges(spark, sf_dir):
    from tracewright.operators import history

    return history.edge_changes(earlier(spark, sf_dir), corpus(spark, sf_dir))


@query("dangling_edges_by_type", "SELECT type, CAST(count(*) AS BIGINT) AS n FROM edges WHERE dst NOT IN (SELECT id FROM nodes) GROUP BY 1")
def dangling_edges_by_type(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.edges.join(c.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


@query("first_declared", "SELECT src, dst, CASE WHEN bool_or(layer = 'edges') THEN 'structured' ELSE 'derived:text' END AS origin FROM (SELECT src, dst, 'edges' AS layer FROM edges WHERE type IN ('about', 'rationale') UNION ALL SELECT src, dst, 'refs' FROM refs) GROUP BY 1, 2")
def first_declared(spark, sf_dir):
    from tracewright.operators.corpus import first_declared as first

    c = corpus(spark, sf_dir)
    declared = c.edges.where("type IN ('about', 'rationale')").select("src", "dst", "origin", F.lit(2).alias("seq"))
    mentioned = c.refs.select("src", "dst", F.lit("derived:text").alias("origin"), F.lit(1).alias("seq"))
    both = declared.unionByName(mentioned).withColumn("type", F.lit("any"))
    return first(both).select("src", "dst", "origin")


@query("next_identity", "SELECT CASE WHEN length(following) >= 4 THEN following ELSE lpad(following, 4, '0') END AS id FROM (SELECT CAST(max(CAST(id AS BIGINT)) + 1 AS VARCHAR) AS following FROM clauses)")
def next_identity(spark, sf_dir):
    from tracewright.functions.identity import next_identity as following

    return corpus(spark, sf_dir).nodes.where("kind = 'clause'").agg(following(F.col("id"), 4).alias("id"))


@query("identities", """SELECT c_custkey, CASE WHEN length(bare) >= 4 THEN bare ELSE lpad(bare, 4, '0') END AS identity FROM (
  SELECT c_custkey, regexp_replace(regexp_extract(c_name, '[0-9]+'), '^0+([0-9])', '\\1') AS bare FROM customer)""")
def identities(spark, sf_dir):
    from tracewright.functions.identity import numbered_identity

    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", numbered_identity(F.concat(F.lit("docs/12/"), F.col("c_name"), F.lit(".md")), 4).alias("identity"))


@query("text_functions", """SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens,
  length(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) > 40 AS cut FROM documents""")
def text_functions(spark, sf_dir):
    from tracewright.functions import text as T

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.tokens(F.col("text")).alias("tokens"), T.label(F.col("text")).endswith("...").alias("cut"))


@query("touching", """SELECT DISTINCT e.src AS id, e.dst AS other FROM edges e WHERE dst NOT IN (SELECT id FROM nodes) AND src IN (
  SELECT id FROM nodes WHERE kind = 'principle' UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM nodes WHERE kind = 'principle') UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE kind = 'principle'))""")
def touching(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = checks.touching(c, checks.dangling_ref(c), ["principle"])
    return rows.select("id", F.regexp_extract("detail", "leads to ([^,]+),", 1).alias("other")).distinct()


@query("suggestions", """SELECT id, other, string_agg(near, ', ' ORDER BY nth) AS fix FROM (
  SELECT l.id, l.other, c.near, row_number() OVER (PARTITION BY l.id, l.other ORDER BY c.distance, c.near) AS nth FROM lost l JOIN close c ON c.other = l.other AND c.near <> l.id
) WHERE nth <= 3 GROUP BY 1, 2""", more="""lost AS (
  SELECT DISTINCT src AS id, dst AS other FROM edges WHERE dst NOT IN (SELECT id FROM nodes)
), close AS (
  SELECT * FROM (
    SELECT l.other, n.id AS near, abs(n.n - l.n) AS distance, row_number() OVER (PARTITION BY l.other ORDER BY abs(n.n - l.n), n.id) AS place
    FROM (SELECT DISTINCT other, CAST(regexp_extract(other, '[0-9]+') AS BIGINT) AS n FROM lost) l, (SELECT id, CAST(regexp_extract(id, '[0-9]+') AS BIGINT) AS n FROM nodes) n
  ) WHERE place <= 4
)""")
def suggestions(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = checks.suggestions(c, checks.dangling_ref(c))
    return rows.select("id", F.regexp_extract("detail", "leads to ([^,]+),", 1).alias("other"), "fix").distinct()


@query("parse_documents", "SELECT id, status, modality, tier, expires, array_to_string(tags, ',') AS tags FROM clauses")
def parse_documents(spark, sf_dir):
    """Clauses are written as Markdown and read back."""
    from tracewright.sources import markdown
    from tracewright.views import config

    c = corpus(spark, sf_dir)
    own = c.nodes.where("kind = 'clause'")
    lines = F.map_entries(F.map_filter("scalars", lambda k, v: k != "kind"))
    block = F.array_join(F.transform(lines, lambda x: F.concat(x["key"], F.lit(": '"), x["value"], F.lit("'"))), "\n")
    tags = F.coalesce(F.concat(F.lit("\ntags: ["), F.array_join(F.try_element_at("lists", F.lit("tags")), ", "), F.lit("]")), F.lit(""))
    text = F.concat(F.lit("---\n"), block, tags, F.lit("\n---\n# Clause\n"))
    files = own.select("path", "kind", F.encode(text, "UTF-8").alias("content"))
    nodes = markdown.build_nodes(markdown.documents(files, config()), config())
    get = lambda k: F.try_element_at("scalars", F.lit(k)).alias(k)
    return nodes.select("id", "status", get("modality"), get("tier"), get("expires"), F.array_join(F.try_element_at("lists", F.lit("tags")), ",").alias("tags"))
