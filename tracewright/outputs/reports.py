"""Findings, records, statistics and differences as lines of text, JSON and annotations.

Lines are columns over the rows they tell of, so a report is as distributed as what it
reports; only ``written`` brings its lines to the driver, one partition after the other.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import checks
from tracewright.scratch import stored

#: Shapes that readers of the reports rely on.
REPORT_VERSION = 2
DIFF_VERSION = 1
LINT_VERSION = 1
PLAN_VERSION = 1
NOTHING = "-"
TOOL = "tracewright"


def or_blank(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def optional(df: DataFrame, *names: str) -> DataFrame:
    """df with null columns for names it lacks."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def place() -> Column:
    """``path:line: ``, without what is unknown."""
    whole = F.concat(F.col("path"), F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""), F.lit(": "))
    return F.when(or_blank("path") == "", F.lit("")).otherwise(whole)


def finding_line() -> Column:
    """``path:line: SEVERITY rule id: detail``, and its fix on a second line."""
    name = F.when(or_blank("id") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.col("id")))
    fix = F.when(or_blank("fix") == "", F.lit("")).otherwise(F.concat(F.lit("\n  fix: "), F.col("fix")))
    return F.concat(place(), F.upper("severity"), F.lit(" "), F.col("rule"), name, F.lit(": "), F.col("detail"), fix)


def location() -> Column:
    return F.struct(or_blank("path").alias("path"), F.when(F.col("line") > 0, F.col("line")).alias("line"))


def finding_json() -> Column:
    """One finding as a JSON object; what it has not is left out."""
    related = F.when(F.size("related") > 0, F.col("related"))
    shape = F.struct(
        "severity", "rule", or_blank("id").alias("id"), "detail", location().alias("location"), related.alias("related"), F.when(or_blank("fix") != "", F.col("fix")).alias("fix"), F.when(F.col("suppressed"), F.lit(True)).alias("suppressed")
    )
    return F.to_json(shape)


def annotation() -> Column:
    """A workflow command; info is a notice."""
    level = F.when(F.col("severity") == "warn", "warning").when(F.col("severity") == "info", "notice").otherwise("error")
    return command(level, F.col("path"), F.col("line"), F.col("rule"), F.concat(F.when(or_blank("id") == "", F.lit("")).otherwise(F.concat(F.col("id"), F.lit(": "))), F.col("detail")))


def command(level: Column, path: Column, line: Column, title: Column, detail: Column) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(or_blank(path) != "", F.concat(F.lit("file="), T.escaped_property(path))),
            F.when(line > 0, F.concat(F.lit("line="), line.cast("string"))),
            F.concat(F.lit("title="), T.escaped_property(title)),
        )
    )
    return F.concat(F.lit("::"), level, F.lit(" "), F.array_join(parts, ","), F.lit("::"), T.escaped_data(detail))


def diagnostic_json() -> Column:
    """One finding in the diagnostic format of review tools."""
    severity = F.when(F.col("severity") == "warn", "WARNING").when(F.col("severity") == "info", "INFO").otherwise("ERROR")
    name = F.when(or_blank("id") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.col("id")))
    spot = F.struct(or_blank("path").alias("path"), F.when(F.col("line") > 0, F.struct(F.struct("line").alias("start"))).alias("range"))
    related = F.transform("related", lambda p: F.struct(F.struct(p.alias("path")).alias("location")))
    shape = F.struct(
        F.concat(F.col("rule"), name, F.lit(": "), F.col("detail")).alias("message"),
        spot.alias("location"),
        severity.alias("severity"),
        F.struct(F.col("rule").alias("value")).alias("code"),
        F.when(F.size("related") > 0, related).alias("related_locations"),
    )
    return F.to_json(shape)


FORMATS = {"text": finding_line, "json": finding_json, "github": annotation, "rdjson": diagnostic_json}


def lines(findings: DataFrame, how: str) -> DataFrame:
    """findings with ``text``, each as the format writes it."""
    return optional(findings, "fix").withColumn("text", FORMATS[how]())


def closing(summary: Row | Mapping, as_of: str = "") -> str:
    """The last line: nothing that reassures where there are errors, but the day in any case."""
    if summary["errors"]:
        return f"as of {as_of}" if as_of else ""
    return f"OK: {summary['documents']} docs, {summary['edges']} typed edges, no cycles" + (f", as of {as_of}" if as_of else "")


def lint_closing(counts: Mapping[str, int], as_of: str = "") -> str:
    if not any(counts.values()):
        line = "OK: no lint findings"
    else:
        parts = [f"{counts[k]} {word if counts[k] == 1 else word + 's'}" for k, word in (("errors", "error"), ("warnings", "warning"))]
        line = ", ".join(parts + ([f"{counts['infos']} info"] if counts["infos"] else []))
    return line + (f", as of {as_of}" if as_of else "")


def header(preset_version: int = 0, as_of: str = "", at: str = "") -> dict:
    return {k: v for k, v in (("preset_version", preset_version), ("as_of", as_of), ("at", at)) if v}


def written(findings: DataFrame, how: str, summary: Mapping, kind: str = "validate", **head) -> Iterator[str]:
    """A whole report in order, piece by piece."""
    counts = dict(summary)
    end = lint_closing(counts, head.get("as_of", "")) if kind == "lint" else closing(counts, head.get("as_of", ""))
    rows = (r.text for r in checks.ordered(lines(findings, how)).select("text").toLocalIterator())
    if how in ("text", "github"):
        yield from rows
        if end:
            yield end
        return
    if how == "rdjson":
        lowest = "INFO" if kind == "lint" else "ERROR"
        worst = "ERROR" if counts.get("errors") else "WARNING" if counts.get("warnings") else lowest
        yield '{"source": {"name": "%s"}, "severity": "%s", "diagnostics": [' % (TOOL, worst)
        yield from joined(rows)
        yield "]}"
        return
    top = ({"kind": "lint"} if kind == "lint" else {}) | {"schema_version": LINT_VERSION if kind == "lint" else REPORT_VERSION} | header(**head)
    yield json.dumps(top)[:-1] + ', "findings": ['
    yield from joined(rows)
    yield '], "summary": ' + json.dumps(counts) + "}"


def joined(rows: Iterable[str]) -> Iterator[str]:
    last = None
    for row in rows:
        if last is not None:
            yield last + ","
        last = row
    if last is not None:
        yield last


FIELDS = ("id", "title", "status", "path")


def records(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids (column id; layer, if there) with title, status and path; an unknown id has none."""
    what = nodes.select("id", "title", "status", "path", "scalars", "lists")
    return ids.join(what, "id", "left")


def field_text(name: str, projections: Iterable[str], keys: Iterable[str]) -> Column:
    if name in FIELDS:
        return or_blank(name)
    if name in projections:
        return F.when(F.col(f"is_{name}"), "true").otherwise("false")
    if name not in keys:
        raise ValueError(f"no field {name}")
    many = F.array_join(F.try_element_at("lists", F.lit(name)), ",")
    return F.coalesce(F.try_element_at("scalars", F.lit(name)), F.when(many != "", many), F.lit(NOTHING))


def record_line(fields: Iterable[str] = ("id",), projections: Iterable[str] = (), keys: Iterable[str] = (), marked: bool = False) -> Column:
    """Fields between tabs; records that are reached by a reference are marked."""
    line = F.concat_ws("\t", *(field_text(f, projections, keys) for f in fields))
    return F.concat(line, F.when(F.col("layer") == "reference", " (reference)").otherwise("")) if marked else line


def record_json(projections: Iterable[str] = (), keys: Iterable[str] = (), marked: bool = False) -> Column:
    """All that is known of a record, null for declared keys that it does not write."""
    parts = [or_blank(f).alias(f) for f in FIELDS]
    if marked:
        parts.append(F.when(F.col("layer") == "reference", F.lit(True)).alias("reference"))
    if projections := list(projections):
        parts.append(F.struct(*(F.when(F.col(f"is_{p}"), "true").otherwise("false").alias(p) for p in projections)).alias("projections"))
    if keys := list(keys):
        one = lambda k: F.to_json(F.array(F.try_element_at("scalars", F.lit(k))), {"ignoreNullFields": "false"})
        value = lambda k: F.coalesce(F.to_json(F.try_element_at("lists", F.lit(k))), F.regexp_extract(one(k), r"^\[(.*)\]$", 1))
        held = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(k) + ":"), value(k)) for k in keys)), F.lit("}"))
        whole = F.to_json(F.struct(*parts))
        return F.concat(F.regexp_replace(whole, r"\}$", ""), F.lit(',"fields":'), held, F.lit("}"))
    return F.to_json(F.struct(*parts))


def stats_lines(values: Mapping) -> list[str]:
    """Statistics (see ``api.Engine.stats``) as aligned lines."""
    rows: list[tuple[str, object]] = [("as of", values["as_of"])] if values.get("as_of") else []
    rows += [("documents", values["documents"]), ("binding", values["binding"]), ("orphans", f"{values['orphans']} ({values['orphan_rate'] * 100:.1f}%)")]
    rows += [(f"{e['type']} edges", e["count"]) for e in values["edges"]]
    rows += [(f"chain depth {d['depth']}", d["count"]) for d in values["chain_depth"]]
    rows += [(f"references to {r['id']}", r["count"]) for r in values["top_referenced"]]
    rows += [(f"modality {m['modality']}", m["count"]) for m in values.get("modalities", ())]
    rows += [(f"clauses about {t['topic']}", t["clauses"]) for t in values.get("topics", ())]
    if values.get("topics"):
        rows.append(("suppressed conflicts", values["suppressed_conflicts"]))
    width = max(len(k) for k, _ in rows) + 2
    return [f"{k:<{width}}{v}" for k, v in rows]


def usage_line() -> Column:
    """Field usage as a row of a table with the columns field, documents, last change, deprecated."""
    return F.concat_ws("\t", "key", F.col("documents").cast("string"), F.coalesce("last_change", F.lit(NOTHING)), F.when(F.col("deprecated"), "yes").otherwise(NOTHING))


def usage_json() -> Column:
    return F.to_json(F.struct(F.col("key").alias("field"), "documents", "deprecated", "last_change"))


#: Order of the parts of a difference.
PARTS = ("added edge", "removed edge", "status", "added document", "removed document")


def change_line() -> Column:
    """``op label rest`` of rows with part, label and rest; labels stand in one column where ``width`` is there."""
    op = F.when(F.col("part").startswith("added"), "+").when(F.col("part").startswith("removed"), "-").otherwise("~")
    return F.concat(op, F.lit(" "), F.rpad("label", F.col("width"), " "), F.lit(" "), F.col("rest"))


def change_rows(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """part, label, rest, key of all differences, from ``history.document_changes`` and ``edge_changes``."""
    e = edges.select(F.concat("op", F.lit(" edge")).alias("part"), F.col("type").alias("label"), F.concat("src", F.lit(" -> "), "dst").alias("rest"), F.array("type", "src", "dst").alias("key"))
    part = F.when(F.col("op") == "status", "status").otherwise(F.concat("op", F.lit(" document")))
    rest = F.when(F.col("op") == "status", F.concat("id", F.lit(": "), or_blank("before"), F.lit(" -> "), or_blank("after"))).otherwise(F.concat("id", F.lit(" ["), F.coalesce("after", "before", F.lit("")), F.lit("]")))
    d = documents.select(part.alias("part"), F.when(F.col("op") == "status", "status").otherwise("document").alias("label"), rest.alias("rest"), F.array("id").alias("key"))
    both = stored(e.unionByName(d))
    return both.join(F.broadcast(both.agg(F.coalesce(F.max(F.length("label")), F.lit(0)).alias("width"))), F.lit(True))


def change_lines(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """text of each difference, in order: edges by type and ends, status, documents."""
    nth = F.array_position(F.array(*(F.lit(p) for p in PARTS)), F.col("part"))
    return change_rows(documents, edges).withColumn("text", change_line()).orderBy(nth, "key")


def change_annotation(title: str = f"{TOOL} diff") -> Column:
    return command(F.lit("notice"), F.lit(""), F.lit(0), F.lit(title), F.col("text"))


def binding_line(before: int, after: int) -> str:
    return f"binding: {before} -> {after} ({after - before:+d})" if after != before else f"binding: {before} -> {after} (0)"


def plan_lines(plan: Mapping, field: str) -> list[str]:
    """What making a document would write."""
    verb = "exists" if plan["exists"] else "create"
    return [f"{verb} {plan['id']} {plan['path']}", *(f"rewrite {r['path']} {field}: {r['status']}" for r in plan["rewrites"])]


def plan_json(plan: Mapping) -> str:
    return json.dumps({"schema_version": PLAN_VERSION, **{k: plan[k] for k in ("id", "path", "exists", "rewrites")}})


def paths_json(paths: Iterable[str] | str) -> str:
    return json.dumps({"path": paths} if isinstance(paths, str) else {"paths": list(paths)})
