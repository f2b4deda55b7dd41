"""Integrity checks: each gives findings as a DataFrame; ``findings`` is their union."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions.identity import unpadded
from tracewright.operators import graph
from tracewright.operators.corpus import FINDING, Corpus
from tracewright.scratch import stored
from tracewright.operators.periods import by_kind
from tracewright.plans import conditions
from tracewright.plans.config import SEVERITIES, Config

STANDARD = {  # rule: severity
    "invalid_frontmatter": "error", "missing_frontmatter": "warn", "id_collision": "error", "id_mismatch": "error", "kind_mismatch": "error",
    "unknown_field": "error", "unknown_status": "error", "empty_edge": "error", "invalid_ref": "error", "dangling_ref": "error",
    "padding_mismatch": "error", "invalid_retraction": "error", "unmanaged_file": "warn", "missing_section": "error", "section_order": "error",
    "unknown_field_value": "error", "missing_field": "error", "deprecated_field": "warn", "edge_kind_mismatch": "error", "edge_attr_unknown": "error",
    "edge_attr_missing": "error", "edge_attr_invalid": "error", "cycle": "error", "cardinality": "error", "inverse_mismatch": "error",
    "unstructured_supersedes": "warn", "derived_conflict": "error", "stale_target": "error", "path_mismatch": "error", "modality_conflict": "error",
    "excepts_strict": "error", "period_invalid": "error", "period_conflict": "error", "expired_deviation": "warn", "dangling_reference": "off",
    "unmentioned_edge": "off", "immutable_violation": "error",
}


def line_of(*keys: str, status: str = "status") -> Column:
    """The line of the first key that is there, else of the status, else of the block."""
    return F.coalesce(*(F.try_element_at("key_lines", F.lit(k)) for k in (*keys, status)), F.col("line"))


def found(rows: DataFrame, rule: str, cfg: Config, detail: Column, line: Column | None = None, related: Column | None = None, severity: Column | str | None = None, suppressed: Column | None = None) -> DataFrame:
    """Findings from rows with id and path."""
    standard = severity if severity is not None else cfg.severity(rule, STANDARD.get(rule, "warn"))
    return rows.select(
        (standard if isinstance(standard, Column) else F.lit(standard)).alias("severity"),
        F.lit(rule).alias("rule"),
        "id",
        detail.alias("detail"),
        "path",
        (line if line is not None else F.col("line")).cast("int").alias("line"),
        (related if related is not None else F.array().cast("array<string>")).alias("related"),
        (suppressed if suppressed is not None else F.lit(False)).alias("suppressed"),
    )


def none(corpus: Corpus) -> DataFrame:
    return corpus.spark.createDataFrame([], FINDING)


def located(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """rows with id, joined to where the node stands."""
    return rows.join(corpus.nodes.select("id", "path", "line", "key_lines"), "id")


def id_collision(c: Corpus) -> DataFrame:
    if c.documents is None:
        return none(c)
    twice = c.documents.where("id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.min("path").alias("path")).where(F.size("paths") > 1)
    return found(twice.withColumn("line", F.lit(1)), "id_collision", c.cfg, F.concat(F.lit("is the identity of "), F.array_join("paths", ", ")), related=F.col("paths"))


def kind_mismatch(c: Corpus) -> DataFrame:
    own = F.try_element_at("scalars", F.lit("declared_kind"))
    return found(c.nodes.where(own.isNotNull() & (own != F.col("kind"))), "kind_mismatch", c.cfg, F.format_string("says kind %s, stands under %s", own, F.col("kind")), line_of("kind"))


def unknown_field(c: Corpus) -> DataFrame:
    cfg = c.cfg
    base = {"title", "date", "id", "kind", "retracts", "declared_kind", cfg.status_field}

    def known(k) -> Column:
        keys = base | {n for n, _ in k.fields} | {x for e in cfg.edges for x in (e.key, e.inverse) if x} | {f for p in [k.period] if p for f in (p.start, p.until)}
        return F.array(*(F.lit(x) for x in sorted(keys))) if k.closed else F.lit(None).cast("array<string>")

    rows = c.nodes.withColumn("known", by_kind(cfg, known)).where("known IS NOT NULL").withColumn("key", F.explode(F.map_keys("key_lines"))).where(~F.array_contains("known", F.col("key")))
    return found(rows, "unknown_field", cfg, F.concat(F.lit("has no field "), F.col("key")), F.try_element_at("key_lines", F.col("key")))


def unknown_status(c: Corpus) -> DataFrame:
    words = by_kind(c.cfg, lambda k: F.array(*(F.lit(s.lower()) for s in (k.statuses or c.cfg.statuses))).cast("array<string>"))
    status = F.lower(F.trim("status"))
    rows = c.nodes.withColumn("words", words).where((F.size("words") > 0) & (status != "") & ~F.array_contains("words", status))
    return found(rows, "unknown_status", c.cfg, F.concat(F.lit("has the unknown status "), F.col("status")), line_of(c.cfg.status_field))


def dangling_ref(c: Corpus) -> DataFrame:
    """Exactly one end is known; the known one is told."""
    lost = c.ends.join(c.unknown.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"), "type")
    sourceless = c.ends.join(c.unknown.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"), "type")
    rows = located(lost.union(sourceless), c)
    return found(rows, "dangling_ref", c.cfg, F.format_string("%s leads to %s, which is unknown", F.col("type"), F.col("other")), key_line(c.cfg))


def key_line(cfg: Config) -> Column:
    """The line of the key that declares the edge in column type."""
    keys = F.create_map(*(F.lit(x) for e in cfg.edges for x in (e.name, e.key))) if cfg.edges else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at("key_lines", F.coalesce(F.try_element_at(keys, F.col("type")), F.lit(""))), line_of())


def padding_mismatch(c: Corpus) -> DataFrame:
    """An unknown end that is the only known id but for leading zeros."""
    ids = c.nodes.select("id", unpadded(F.col("id")).alias("bare"))
    single = ids.groupBy("bare").agg(F.count("*").alias("n"), F.min("id").alias("meant")).where("n = 1")
    lost = c.edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").withColumn("bare", unpadded(F.col("dst")))
    rows = located(lost.join(single, "bare").select(F.col("src").alias("id"), "dst", "meant", "type"), c)
    return found(rows, "padding_mismatch", c.cfg, F.format_string("%s names %s; the document is %s", F.col("type"), F.col("dst"), F.col("meant")), key_line(c.cfg))


def field_items(c: Corpus) -> DataFrame:
    """id, kind, path, line, key_lines and each declared field's values."""
    return c.nodes.select("id", "kind", "path", "line", "key_lines", "scalars", "lists")


def declared_fields(c: Corpus) -> list[tuple[str | None, str, object]]:
    return [(None if not c.cfg.multikind else k, name, f) for k, kind in c.cfg.kind_items() for name, f in (*c.cfg.fields, *(kind.fields if c.cfg.multikind else ()))]


def of_kind(rows: DataFrame, kind: str | None) -> DataFrame:
    return rows if kind is None else rows.where(F.col("kind") == kind)


def unknown_field_value(c: Corpus) -> DataFrame:
    parts = []
    for kind, name, f in declared_fields(c):
        if f.one_of:
            rows = of_kind(field_items(c), kind).withColumn("value", F.explode(conditions.items(name, ()))).where(~F.col("value").isin(*f.one_of))
            parts.append(found(rows, "unknown_field_value", c.cfg, F.format_string(f"{name} is %s, none of {', '.join(f.one_of)}", F.col("value")), line_of(name)))
    return union(c, parts)


def missing_field(c: Corpus) -> DataFrame:
    parts = []
    for kind, name, f in declared_fields(c):
        rows = of_kind(field_items(c), kind)
        one, many, there = F.try_element_at("scalars", F.lit(name)), F.try_element_at("lists", F.lit(name)), F.map_contains_key("key_lines", name)
        blank = F.coalesce(F.trim(one) == "", F.lit(True)) if f.type == "scalar" else one.isNull() & many.isNull()
        tests = []
        if f.required:
            tests.append((blank & many.isNull(), F.lit(f"needs a value for {name}")))
        tests.append((there & (many.isNotNull() if f.type == "scalar" else F.lit(False)), F.lit(f"{name} is a list, not one value")))
        if f.min_items:
            tests.append((there & (F.coalesce(F.size(many), F.when(one.isNotNull(), 1), F.lit(0)) < f.min_items), F.lit(f"{name} needs {f.min_items} items")))
        parts += [found(rows.where(t), "missing_field", c.cfg, d, line_of(name)) for t, d in tests]
    return union(c, parts)


def deprecated_field(c: Corpus) -> DataFrame:
    """A retired key that is still written, even empty; an error after its sunset."""
    parts = []
    for kind, name, f in declared_fields(c):
        if f.deprecated:
            past = f.sunset is not None and c.as_of > f.sunset
            rows = of_kind(field_items(c), kind).where(F.map_contains_key("key_lines", name))
            parts.append(found(rows, "deprecated_field", c.cfg, F.lit(f"{name} is retired" + (f"; {f.replaced_by} takes its place" if f.replaced_by else "")), line_of(name), severity="error" if past else None))
    return union(c, parts)


def edge_kind_mismatch(c: Corpus) -> DataFrame:
    """An end of a kind that the edge does not take; told on the declaring document."""
    allowed = [e for e in c.cfg.edges if e.sources or e.targets]
    if not allowed:
        return none(c)
    edges = stored(c.edges.where(F.col("type").isin([e.name for e in allowed])).select("src", "dst", "type", "origin"))
    taken = {side: reduce(lambda otherwise, e: F.when((F.col("type") == e[0]) & ~F.col("end_kind").isin(*e[1]), True).otherwise(otherwise), [(e.name, getattr(e, kinds)) for e in allowed if getattr(e, kinds)], F.lit(False)) for side, kinds in (("src", "sources"), ("dst", "targets"))}
    ends = reduce(DataFrame.union, (edges.select(F.lit(side).alias("side"), "type", F.col(side).alias("end")) for side in taken)).distinct()
    judged = ends.join(c.nodes.select(F.col("id").alias("end"), F.col("kind").alias("end_kind")), "end")
    wrong = stored(judged.where(F.when(F.col("side") == "src", taken["src"]).otherwise(taken["dst"])))
    parts = []
    for side in taken:  # edges of the types that have a wrong end alone
        own = wrong.where(F.col("side") == side)
        types = [r.type for r in own.select("type").distinct().collect()]
        rows = c.declared_by(edges.where(F.col("type").isin(types))).withColumn("end", F.col(side))
        parts.append(rows.join(own, ["type", "end"]).select(F.col("owner").alias("id"), "type", "end", "end_kind"))
    all_bad = located(reduce(DataFrame.unionByName, parts), c)
    return found(all_bad, "edge_kind_mismatch", c.cfg, F.format_string("%s has an end %s of kind %s", F.col("type"), F.col("end"), F.col("end_kind")), key_line(c.cfg))


def edge_attrs(c: Corpus, rule: str) -> DataFrame:
    """Attributes that are not declared, missing, or of a value that isn't taken."""
    parts = []
    for e in c.cfg.edges:
        own = c.declared_by(c.edges.where(F.col("type") == e.name)).select(F.col("owner").alias("id"), "type", "dst", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))
        names = [n for n, _ in e.attrs]
        if rule == "edge_attr_unknown":
            extra = own.withColumn("name", F.explode(F.map_keys("attrs"))).where(~F.col("name").isin(*names) if names else F.lit(True))
            parts.append(extra.select("id", "type", "dst", "name"))
        for n, a in e.attrs:
            value = F.try_element_at("attrs", F.lit(n))
            if rule == "edge_attr_missing" and a.required:
                parts.append(own.where(value.isNull()).select("id", "type", "dst", F.lit(n).alias("name")))
            if rule == "edge_attr_invalid":
                parts.append(own.where(value.isNotNull() & ~T.accepts(value, a.type, a.one_of)).select("id", "type", "dst", F.lit(n).alias("name")))
    if not parts:
        return none(c)
    rows = located(reduce(DataFrame.unionByName, parts), c)
    return found(rows, rule, c.cfg, F.format_string("%s to %s: attribute %s", F.col("type"), F.col("dst"), F.col("name")), key_line(c.cfg))


def cycle(c: Corpus) -> DataFrame:
    """One finding for each strong component of an acyclic type, and of acyclic_union where a simple cycle needs more than one of its types."""
    alone = [e.name for e in c.cfg.edges if e.acyclic]
    if not alone and not c.cfg.acyclic_union:
        return none(c)
    rows = graph.cycles(c.edges, alone, list(c.cfg.acyclic_union)).withColumnRenamed("path", "way").withColumn("id", F.element_at("way", 1))
    rows = rows.join(c.nodes.select("id", "path", "line", "key_lines"), "id", "left")
    return found(rows, "cycle", c.cfg, F.format_string("%s goes in a circle: %s", F.col("type"), F.array_join("way", " -> ")), key_line(c.cfg), related=F.col("way"))


def cardinality(c: Corpus) -> DataFrame:
    parts = []
    frame = conditions.frame_of(c.nodes, c.edges)
    for e in c.cfg.edges:
        n_in, n_out = (F.coalesce(F.try_element_at(F.col(s), F.lit(e.name)), F.lit(0)) for s in ("deg_in", "deg_out"))
        for bound, n, over, kinds in ((e.max_inbound, n_in, True, e.targets), (e.max_outbound, n_out, True, e.sources), (e.min_outbound, n_out, False, e.sources)):
            if bound is not None:
                rows = frame.where(n > bound if over else n < bound)
                rows = rows.where(F.col("kind").isin(*kinds)) if kinds and c.cfg.multikind else rows
                parts.append(found(rows, "cardinality", c.cfg, F.format_string(f"{e.name}: %d where {'at most' if over else 'at least'} {bound} fit", n), line_of(e.key)))
    return union(c, parts)


def inverse_mismatch(c: Corpus) -> DataFrame:
    """A mirrored key (lists of ids) and the edges disagree, either way."""
    parts = []
    for e in c.cfg.edges:
        if not e.inverse:
            continue
        said = c.nodes.where(F.map_contains_key("key_lines", e.inverse)).select("id", F.explode(conditions.items(e.inverse, ())).alias("other"))
        real = c.edges.where(F.col("type") == e.name).select(F.col("dst").alias("id"), F.col("src").alias("other"))
        gone = c.retractions.where(F.col("type") == e.name).select(F.col("dst").alias("id"), F.col("src").alias("other")) if c.retractions is not None else real.limit(0)
        writers = c.nodes.where(F.map_contains_key("key_lines", e.inverse)).select("id")
        unreal = said.join(real.union(gone), ["id", "other"], "left_anti")
        unsaid = real.join(writers, "id", "left_semi").join(said, ["id", "other"], "left_anti")
        for rows, detail in ((unreal, f"{e.inverse} lists %s, which declares no {e.name}"), (unsaid, f"{e.inverse} leaves out %s, which declares {e.name}")):
            parts.append(found(located(rows, c), "inverse_mismatch", c.cfg, F.format_string(detail, F.col("other")), line_of(e.inverse)))
    return union(c, parts)


def unstructured_supersedes(c: Corpus) -> DataFrame:
    rows = located(c.edges.where(F.col("origin").startswith("derived")).select(F.col("dst").alias("id"), F.col("src").alias("other"), "type"), c)
    return found(rows, "unstructured_supersedes", c.cfg, F.format_string("only a status names %s; declare %s there", F.col("other"), F.col("type")), line_of())


def derived_conflict(c: Corpus) -> DataFrame:
    derived = c.edges.where(F.col("origin").startswith("derived")).select("src", "dst", "type")
    turned = c.edges.where(~F.col("origin").startswith("derived")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    rows = located(derived.join(turned, ["src", "dst", "type"], "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"), "type"), c)
    return found(rows, "derived_conflict", c.cfg, F.format_string("%s and its status say the opposite of each other about %s", F.col("type"), F.col("other")), line_of())


def leaves(c: Corpus, edge: str) -> DataFrame:
    """id of nodes that a successor over ``edge`` has replaced: one that is accepted and in force, for targets whose kind has periods; any, for others."""
    ends = c.edges.where(F.col("type") == edge).select("src", F.col("dst").alias("id"))
    targets = c.dated.select("id", "declared")
    heads = c.dated.select(F.col("id").alias("src"), (F.coalesce(F.lower("status") == "accepted", F.lit(False)) & F.col("in_force")).alias("stands"))
    both = ends.join(targets, "id").join(heads, "src", "left")
    return both.where(~F.col("declared") | F.coalesce("stands", F.lit(True))).select("id").distinct()


def stale_target(c: Corpus) -> DataFrame:
    """An edge of a declarer in force whose known target fails the edge's condition."""
    parts = []
    owners = c.dated.where("in_force").select(F.col("id").alias("owner"))
    for e in c.cfg.edges:
        if not e.target:
            continue
        own = c.declared_by(c.edges.where(F.col("type") == e.name)).join(owners, "owner", "left_semi").select(F.col("owner").alias("id"), "dst", "type")
        good = c.holding(fits=e.target.condition).select(F.col("id").alias("dst"), "fits")
        rows = own.join(good, "dst")
        if e.target.leaf_of:
            rows = rows.join(leaves(c, e.target.leaf_of).select(F.col("id").alias("dst"), F.lit(True).alias("replaced")), "dst", "left")
        else:
            rows = rows.withColumn("replaced", F.lit(None).cast("boolean"))
        parts.append(rows.where(~F.col("fits") | F.coalesce("replaced", F.lit(False))))
    if not parts:
        return none(c)
    rows = located(reduce(DataFrame.unionByName, parts), c)
    return found(rows, "stale_target", c.cfg, F.format_string("%s leads to %s, which it may not", F.col("type"), F.col("dst")), key_line(c.cfg))


def path_mismatch(c: Corpus) -> DataFrame:
    parts = []
    for p in c.cfg.path_constraints:
        reached = graph.walk(c.edges, p.path)
        if p.subset_of is not None:
            reached = reached.join(graph.walk(c.edges, p.subset_of), ["src", "dst"], "left_anti")
        rows = located(reached.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("outside")), c)
        parts.append(found(rows, "path_mismatch", c.cfg, F.format_string(f"{p.name}: reaches %s", F.array_join("outside", ", ")), line_of(), related=F.col("outside"), severity=p.severity))
    return union(c, parts)


def modality_pairs(c: Corpus) -> DataFrame:
    """a, b, modality_a, modality_b, topics, strong, defeater of binding clauses that share a topic and can't both be met.

    The pairs of a topic are joined on it with the side of prohibitions and the other
    side, so no pair of like clauses is made; skewed topics are split at run time.
    """
    bound = c.binding.select("id", F.try_element_at("scalars", F.lit("modality")).alias("modality")).where(F.col("modality").isin(*T.KNOWN))
    bound = stored(bound)
    own = c.edges.where("type = 'about'").select(F.col("src").alias("id"), F.col("dst").alias("topic")).join(bound, "id")
    on = stored(own.join(c.nodes.select(F.col("id").alias("topic")), "topic", "left_semi").select("id", "topic", "modality").distinct())
    forbids, asks = on.where(T.prohibits(F.col("modality"))), on.where(~T.prohibits(F.col("modality")))
    both = forbids.select("topic", F.col("id").alias("x"), F.col("modality").alias("mx")).join(asks.select("topic", F.col("id").alias("y"), F.col("modality").alias("my")), "topic")
    first = F.col("x") < F.col("y")
    pairs = both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.first(F.when(first, F.col("mx")).otherwise(F.col("my"))).alias("modality_a"), F.first(F.when(first, F.col("my")).otherwise(F.col("mx"))).alias("modality_b"), F.sort_array(F.collect_set("topic")).alias("topics")
    )
    pairs = pairs.withColumn("strong", T.strict(F.col("modality_a")) & T.strict(F.col("modality_b")))
    excepts = c.weighing.where("type = 'excepts'").select("src", "dst").distinct()
    straight = excepts.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("ab"))
    back = excepts.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("ba"))
    judged = pairs.join(straight, ["a", "b"], "left").join(back, ["a", "b"], "left")
    defeater = F.when(~F.col("strong") & F.coalesce("ab", F.lit(False)), F.col("a")).when(~F.col("strong") & F.coalesce("ba", F.lit(False)), F.col("b"))
    return judged.withColumn("defeater", defeater).drop("ab", "ba")


def conflict_text() -> Column:
    return F.format_string("%s conflicts with %s (%s) on %s", F.col("modality_a"), F.col("b"), F.col("modality_b"), F.array_join("topics", ", "))


def settled_text() -> Column:
    """A conflict that an exception settles, from columns of ``modality_pairs``."""
    other = F.when(F.col("defeater") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return F.format_string("%s (%s) and %s (%s) on %s: settled, %s makes an exception to %s", F.col("a"), F.col("modality_a"), F.col("b"), F.col("modality_b"), F.array_join("topics", ", "), F.col("defeater"), other)


def modality_conflict(c: Corpus) -> DataFrame:
    if c.cfg.edge("about") is None:
        return none(c)
    rows = located(modality_pairs(c).withColumnRenamed("a", "id"), c)
    return found(rows, "modality_conflict", c.cfg, conflict_text(), line_of("modality"), related=F.array("b"), suppressed=F.col("defeater").isNotNull())


def excepts_strict(c: Corpus) -> DataFrame:
    strict = c.nodes.where(T.strict(F.try_element_at("scalars", F.lit("modality")))).select(F.col("id").alias("dst"))
    rows = located(c.edges.where("type = 'excepts'").join(strict, "dst", "left_semi").select(F.col("src").alias("id"), "dst", "type"), c)
    return found(rows, "excepts_strict", c.cfg, F.concat(F.lit("makes an exception to "), F.col("dst"), F.lit(", which allows none")), key_line(c.cfg))


def period_invalid(c: Corpus) -> DataFrame:
    parts = []
    for kind, k in c.cfg.kind_items():
        if k.period:
            rows = of_kind(c.dated, kind if c.cfg.multikind else None)
            for key in (k.period.start, k.period.until):
                raw = F.col("date") if key == "date" else F.try_element_at("scalars", F.lit(key))
                parts.append(found(rows.where((F.trim(raw) != "") & T.valid_day(raw).isNull()), "period_invalid", c.cfg, F.format_string(f"{key} is no day: %s", raw), line_of(key)))
            parts.append(found(rows.where("explicit_until < from_day"), "period_invalid", c.cfg, F.format_string("ends on %s, before it begins on %s", F.col("explicit_until"), F.col("from_day")), line_of(k.period.until)))
    return union(c, parts)


def period_conflict(c: Corpus) -> DataFrame:
    rows = c.dated.where("explicit_until <> derived_until")
    return found(rows, "period_conflict", c.cfg, F.format_string("says that it ends on %s; its successor begins on %s", F.col("explicit_until"), F.col("derived_until")), line_of())


def expired_deviation(c: Corpus) -> DataFrame:
    rows = c.dated.where((F.lower("status") == "accepted") & (F.col("explicit_until") <= c.as_of))
    return found(rows, "expired_deviation", c.cfg, F.concat(F.lit("is still accepted, though it ended on "), F.col("explicit_until")), line_of())


def dangling_reference(c: Corpus) -> DataFrame:
    severity = c.cfg.references.dangling
    if severity == "off" or c.refs is None:
        return none(c)
    lost = c.refs.join(c.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"), "dst").distinct()
    return found(located(lost, c), "dangling_reference", c.cfg, F.concat(F.lit("links to "), F.col("dst"), F.lit(", which is unknown")), severity=severity)


def unmentioned_edge(c: Corpus) -> DataFrame:
    parts = []
    for e in c.cfg.edges:
        if e.require_mention != "off" and c.refs is not None:
            own = c.declared_by(c.edges.where((F.col("type") == e.name) & ~F.col("origin").startswith("derived"))).withColumn("other", F.when(F.col("owner") == F.col("src"), F.col("dst")).otherwise(F.col("src")))
            unsaid = own.select(F.col("owner").alias("id"), "other", "type").join(c.refs.select(F.col("src").alias("id"), F.col("dst").alias("other")), ["id", "other"], "left_anti")
            parts.append(found(located(unsaid, c), "unmentioned_edge", c.cfg, F.format_string("%s to %s is not mentioned in the text", F.col("type"), F.col("other")), key_line(c.cfg), severity=e.require_mention))
    return union(c, parts)


def rules(c: Corpus) -> DataFrame:
    """All rules in one pass: a node gives a finding for each that holds on it."""
    active = [r for r in c.cfg.rules if r.severity != "off"]
    if not active:
        return none(c)
    held = c.holding(**{f"rule_{i}": r.when for i, r in enumerate(active)})
    one = [F.when(F.col(f"rule_{i}"), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.name).alias("rule"), F.lit(r.message).alias("detail"))) for i, r in enumerate(active)]
    rows = held.withColumn("hit", F.explode(F.array_compact(F.array(*one))))
    line = line_of(status=c.cfg.status_field)
    return rows.select("hit.severity", "hit.rule", "id", "hit.detail", "path", line.alias("line"), F.array().cast("array<string>").alias("related"), F.lit(False).alias("suppressed"))


CHECKS: dict[str, Callable[[Corpus], DataFrame]] = {
    "id_collision": id_collision,
    "kind_mismatch": kind_mismatch,
    "unknown_field": unknown_field,
    "unknown_status": unknown_status,
    "dangling_ref": dangling_ref,
    "padding_mismatch": padding_mismatch,
    "unknown_field_value": unknown_field_value,
    "missing_field": missing_field,
    "deprecated_field": deprecated_field,
    "edge_kind_mismatch": edge_kind_mismatch,
    **{rule: (lambda c, rule=rule: edge_attrs(c, rule)) for rule in ("edge_attr_unknown", "edge_attr_missing", "edge_attr_invalid")},
    "cycle": cycle,
    "cardinality": cardinality,
    "inverse_mismatch": inverse_mismatch,
    "unstructured_supersedes": unstructured_supersedes,
    "derived_conflict": derived_conflict,
    "stale_target": stale_target,
    "path_mismatch": path_mismatch,
    "modality_conflict": modality_conflict,
    "excepts_strict": excepts_strict,
    "period_invalid": period_invalid,
    "period_conflict": period_conflict,
    "expired_deviation": expired_deviation,
    "dangling_reference": dangling_reference,
    "unmentioned_edge": unmentioned_edge,
    "rules": rules,
}


def union(c: Corpus, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else none(c)


def findings(c: Corpus, names: list[str] | None = None) -> DataFrame:
    """Findings of the build and of all checks (or of those named)."""
    parts = [CHECKS[n](c) for n in (names or CHECKS)]
    if c.build_findings is not None and names is None:
        parts.insert(0, c.build_findings)
    return union(c, parts)


def rank(severity: Column) -> Column:
    return reduce(lambda otherwise, s: F.when(severity == s[1], F.lit(s[0])).otherwise(otherwise), reversed(list(enumerate(SEVERITIES))), F.lit(len(SEVERITIES)))


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(rank(F.col("severity")), "path", "line", "rule", "id", "detail")


def summary(c: Corpus, rows: DataFrame) -> DataFrame:
    """documents, edges, errors, warnings, cycles; what is suppressed doesn't count."""
    counted = rows.where("NOT suppressed").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"), F.count_if(F.col("rule") == "cycle").alias("cycles"))
    return c.nodes.agg(F.count("*").alias("documents")).join(c.edges.agg(F.count("*").alias("edges"))).join(counted)


def touching(c: Corpus, rows: DataFrame, paths: list[str]) -> DataFrame:
    """Findings on named files or folders, related to them, or one typed edge from them."""
    here = reduce(or_, ((F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/") for p in paths), F.lit(False))
    own = stored(c.nodes.where(here).select("id"))
    near = c.edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).union(c.edges.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")))
    ids = own.union(near).distinct()
    keyed = stored(rows.withColumn("key", F.monotonically_increasing_id()))
    meant = keyed.select("key", F.explode(F.concat(F.array("id"), "related")).alias("id")).join(ids, "id", "left_semi").select("key").distinct()
    return keyed.join(meant, "key", "left_semi").unionByName(keyed.where(here & F.col("id").isNull())).drop("key")


def suggestions(c: Corpus, rows: DataFrame, most: int = 3) -> DataFrame:
    """Adds fix: for an unknown id, the known ids whose numbers are nearest, nearest first, without the finding's own.

    Known numbers have places in their order, counted by range partitions; of an unknown one, the
    numbers at ``most + 1`` places to each side hold the nearest ids.  Nearest ids are sought once for each number,
    one more than asked for, as a finding's own may be among them.
    """
    from tracewright.functions.identity import number_of

    lost = F.when(F.col("rule") == "dangling_ref", F.regexp_extract("detail", "leads to (.*), which is unknown$", 1))
    keyed = stored(rows.withColumn("n", number_of(lost)))
    lost = stored(keyed.select("n").where("n IS NOT NULL").distinct())
    if lost.limit(1).count() == 0:
        return keyed.drop("n").withColumn("fix", F.lit(None).cast("string"))
    ids = c.nodes.select(F.col("id").alias("near"), number_of(F.col("id")).alias("m")).where("m IS NOT NULL").distinct()
    nth = F.row_number().over(Window.partitionBy("m").orderBy("near"))
    few = ids.withColumn("nth", nth).where(F.col("nth") <= most + 1).groupBy("m").agg(F.sort_array(F.collect_list("near")).alias("nears"))
    both = few.select("m", "nears").unionByName(lost.toDF("m"), allowMissingColumns=True)
    dealt = stored(both.repartitionByRange(F.col("m")).withColumn("part", F.spark_partition_id()))
    before, counts = 0, []
    for part, n in sorted(map(tuple, dealt.groupBy("part").agg(F.count("nears")).collect())):
        counts.append((part, before))
        before += n
    offsets = c.spark.createDataFrame(counts, "part int, before bigint")
    inside = Window.partitionBy("part").orderBy("m", F.col("nears").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stored(dealt.withColumn("at", F.count("nears").over(inside)).join(F.broadcast(offsets), "part").select("m", "nears", (F.col("at") + F.col("before")).alias("place")))
    sought = placed.where("nears IS NULL").select(F.col("m").alias("n"), F.explode(F.sequence(F.col("place") - most, F.col("place") + most + 1)).alias("place"))
    close = sought.join(placed.where("nears IS NOT NULL"), "place").select("n", "m", F.explode("nears").alias("near"))
    order = Window.partitionBy("n").orderBy(F.abs(F.col("n") - F.col("m")), "near")
    best = close.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most + 1).groupBy("n").agg(F.sort_array(F.collect_list(F.struct("nth", "near"))).alias("best"))
    best = stored(best.select("n", F.col("best.near").alias("best")))
    others = F.slice(F.filter("best", lambda x: ~x.eqNullSafe(F.col("id"))), 1, most)
    return keyed.join(best, "n", "left").withColumn("fix", F.when(F.size(others) > 0, F.array_join(others, ", "))).drop("n", "best")


def supersedes_key(cfg: Config) -> str:
    e = cfg.edge("supersedes")
    return e.key if e else "supersedes"


def with_fixes(c: Corpus, rows: DataFrame) -> DataFrame:
    """Adds fix, what would mend a finding; null where nothing general can be said."""
    cfg = c.cfg
    status = cfg.status_field
    near = suggestions(c, rows).withColumnRenamed("fix", "near")
    names = F.split("near", ", ")
    rule = F.col("rule")
    words = ", ".join(cfg.statuses)
    derived = c.edges.where(F.col("origin").startswith("derived")).groupBy(F.col("dst").alias("fixed")).agg(F.min("src").alias("holder"), F.min_by("type", "src").alias("edge"))
    keys = F.create_map(*(F.lit(x) for e in cfg.edges for x in (e.name, e.key))) if cfg.edges else F.create_map().cast("map<string,string>")
    leaf = standing(c).withColumnRenamed("id", "leaf_of")
    meant = F.regexp_extract("detail", "leads to (.*), which it may not$", 1)
    out = near.join(derived, (rule == "unstructured_supersedes") & (F.col("id") == F.col("fixed")), "left").join(leaf, (rule == "stale_target") & (meant == F.col("leaf_of")), "left")
    fix = (
        F.when(rule == "dangling_ref", F.when(F.col("near").isNotNull(), F.concat(F.lit("did you mean "), T.alternatives(names), F.lit("?"))))
        .when(rule == "unmentioned_edge", F.format_string("cite [[%s]] or link to it in the text", F.regexp_extract("detail", " to (.*) is not mentioned", 1)))
        .when(rule == "status_drift", F.concat(F.lit(f"set {status}: superseded in "), F.col("path")))
        .when(rule == "superseded_orphan", F.concat(F.lit(f"declare {supersedes_key(cfg)}: "), F.col("id"), F.lit(f" in the document that replaces it, or set {status}: withdrawn")))
        .when(rule == "unstructured_supersedes", F.concat(F.lit("declare "), F.coalesce(F.try_element_at(keys, F.col("edge")), F.col("edge")), F.lit(": "), F.col("id"), F.lit(" in "), F.col("holder")))
        .when(rule == "stale_target", F.concat(F.lit("lead to "), F.col("leaf"), F.lit(" instead")))
        .when((rule == "unknown_status") & F.lit(bool(words)), F.lit(f"use one of: {words}"))
        .when(rule == "missing_frontmatter", F.lit(f"add a block with title and {status}"))
        .when(rule == "cycle", F.lit("remove one of its edges"))
        .when(rule == "deprecated_field", F.concat(F.lit("move "), F.nullif(F.regexp_extract("detail", "^(.*) is retired; (.*) takes its place$", 1), F.lit("")), F.lit(" to "), F.regexp_extract("detail", "; (.*) takes its place$", 1)))
        .when(rule == "unmanaged_file", F.lit("rename the file, or move it out of the folder"))
    )
    return out.withColumn("fix", fix).drop("near", "fixed", "holder", "edge", "leaf_of", "leaf")


def standing(c: Corpus) -> DataFrame:
    """id and leaf: the only accepted document in force that supersedes it at once."""
    heads = c.dated.where((F.lower("status") == "accepted") & F.col("in_force")).select(F.col("id").alias("src"))
    ends = c.edges.where("type = 'supersedes'").join(heads, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("leaf"), F.count("*").alias("n"))
    return ends.where("n = 1").select("id", "leaf")
