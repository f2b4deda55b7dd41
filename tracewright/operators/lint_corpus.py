"""What a corpus says of its configuration: rules and projections that hold nowhere or everywhere, unused edges, fixtures."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import checks, history, stats
from tracewright.operators.corpus import FINDING, Corpus
from tracewright.plans import lint
from tracewright.plans.config import Config, presets
from tracewright.plans.lint import LintFinding

FIRES, SILENT = "ruleid", "ok"
LINT_FINDING = FINDING + ", fix string"


def frame(spark: SparkSession, found: Iterable[LintFinding], path: str = "", lines: Mapping | None = None) -> DataFrame:
    """Findings about a configuration as rows; there are as many as it has parts, not as documents."""
    return spark.createDataFrame(lint.located(found, path, lines), LINT_FINDING)


def numbers(c: Corpus) -> DataFrame:
    """section, name, held, fits: on how many nodes each rule and projection holds, and how many are of a kind that it can hold on.

    One pass over the frame answers all rules, another one all projections.
    """
    analysis = lint.Analysis(c.cfg)
    scopes = []
    for u in analysis.units:
        if u.section != "edges":
            kinds = analysis.unit_kinds(u)
            scopes += [(u.section, u.name, kind) for kind in (kinds if kinds is not None else [None])] or [(u.section, u.name, "")]
    wanted = c.spark.createDataFrame(scopes, "section string, name string, kind string")
    by_kind = c.nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.col("kind").alias("own"), "n")  # a row for each kind
    fits = wanted.join(F.broadcast(by_kind), F.col("kind").isNull() | (F.col("kind") == F.col("own")), "left").groupBy("section", "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fits"))
    held = stats.firing(c).select(F.lit("rules").alias("section"), F.col("rule").alias("name"), F.col("fired").alias("held"))
    if c.cfg.projections:
        held = held.unionByName(stats.holding(c).select(F.lit("projections").alias("section"), F.col("projection").alias("name"), "held"))
    return fits.join(held, ["section", "name"])


def findings(c: Corpus, firable: Iterable[str] = (), base: Corpus | None = None) -> list[LintFinding]:
    """Findings from counts alone.  firable: rules that a fixture shows to fire; base: an earlier state to compare with."""
    out = []
    shown = set(firable)
    for r in sorted(numbers(c).collect()):
        bound = r["section"] == "projections" and r["name"] == c.cfg.binding
        what = f"{r['held']} of {r['fits']} documents"
        if r["section"] == "rules":
            if r["fits"] == 0:
                out.append(LintFinding("info", "never_fired", r["name"], f"holds on {what}: there is none that it could hold on", "", "rules"))
            elif r["held"] == 0 and r["name"] in shown:
                out.append(LintFinding("info", "never_fired", r["name"], f"holds on {what}; a fixture shows that it can", "", "rules"))
            elif r["held"] == 0:
                out.append(LintFinding("warn", "never_fired", r["name"], f"holds on {what}", "keep it if a fixture shows that it can hold", "rules"))
            elif r["held"] == r["fits"]:
                out.append(LintFinding("warn", "always_fired", r["name"], f"holds on {what}", "narrow the rule, or mend the documents", "rules"))
        elif r["fits"]:
            if r["held"] == 0:
                out.append(LintFinding("error" if bound else "warn", "never_true", r["name"], f"holds on {what}" + ("; it is the binding one, so nothing binds" if bound else ""), "widen the projection, or drop it", "projections"))
            elif r["held"] == r["fits"]:
                out.append(LintFinding("warn", "always_true", r["name"], f"holds on {what}", "narrow the projection, or drop it", "projections"))
    unused = stats.edge_counts(c).where("n = 0").orderBy("place").collect()
    out += [LintFinding("info", "unused_edge_in_corpus", r["type"], "is declared, and no document uses it", "", "edges") for r in unused]
    if base is not None:
        for r in history.rule_changes(base, c).orderBy("rule").collect():
            out.append(LintFinding("info", r["change"], r["rule"], "holds now and did not before" if r["change"] == "newly_fired" else "held before and does not now", "", "rules"))
    return out


def holds_on(c: Corpus, name: str) -> DataFrame:
    """id, path, line of the documents on which a rule, a projection or a check fires."""
    if name in c.projections:
        return c.frame.where(F.col(f"is_{name}")).select("id", "path", "line")
    rule = next((r for r in c.cfg.rules if r.name == name), None)
    if rule is not None:
        return c.holding(met=rule.when).where("met").select("id", "path", "line")
    rows = [checks.CHECKS[name](c)] if name in checks.CHECKS else []
    if c.build_findings is not None:
        rows.append(c.build_findings.where(F.col("rule") == name))
    return checks.union(c, rows).where("NOT suppressed").select("id", "path", "line")


def check_fixtures(fixtures: Mapping[tuple[str, str], Callable[[], Corpus]], cfg: Config) -> tuple[list[LintFinding], set[str]]:
    """Findings on missing and failing fixtures, and the rules that one shows to fire.

    fixtures: by rule and side (ruleid must fire, ok must not), what builds that small corpus.
    """
    out, firable = [], set()
    bundled = {r.name for r in presets()[cfg.preset].rules} if cfg.preset in presets() else set()
    for r in cfg.rules:
        for side in (FIRES, SILENT):
            if (r.name, side) not in fixtures and r.name not in bundled:
                out.append(LintFinding("warn", "missing_fixture", r.name, f"has no {side} fixture", "generate one", "rules"))
    known = {r.name for r in cfg.rules} | {p.name for p in cfg.projections} | set(checks.STANDARD)
    for (name, side), corpus in sorted(fixtures.items()):
        if name not in known:
            continue
        fired = [r["id"] for r in holds_on(corpus(), name).orderBy("id").collect()]
        if side == FIRES and fired:
            firable.add(name)
        elif side == FIRES:
            out.append(LintFinding("error", "fixture_mismatch", name, "does not fire in its ruleid fixture", "add a document that it tells of, or widen it", "rules"))
        else:
            out += [LintFinding("error", "fixture_mismatch", name, f"fires on {i} in its ok fixture", "narrow it, or move the document", "rules") for i in fired]
    return out, firable
