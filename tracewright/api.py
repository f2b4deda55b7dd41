"""The commands of the engine over one corpus.

Each returns DataFrames or, where it writes a report, an iterator of lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.identity import normalised
from tracewright.operators import briefs, checks, graph, history, lint_corpus, stats
from tracewright.operators.corpus import Corpus
from tracewright.scratch import stored
from tracewright.outputs import export, reports
from tracewright.plans import discovery
from tracewright.plans.conditions import attr_column
from tracewright.plans.config import IN_FORCE, OPS, AttrTest, ConfigError
from tracewright.plans.lint import LintFinding, lint
from tracewright.sources import markdown, newdoc, revisions

#: What a command ends with.
CLEAN, FAILED, WARNED, UNUSABLE = 0, 1, 2, 3


def exit_status(summary: Mapping) -> int:
    return FAILED if summary["errors"] else CLEAN


def lint_status(counts: Mapping[str, int]) -> int:
    return FAILED if counts["errors"] else WARNED if counts["warnings"] else CLEAN


def parse_test(text: str) -> tuple[str, AttrTest]:
    """key=op:value; key=value stands for eq."""
    key, found, rest = text.partition("=")
    op, named, value = rest.partition(":")
    if not found or not key:
        raise ConfigError(f"a filter is key=op:value: {text}")
    if not named or op not in OPS:
        op, value = "eq", rest
    return key, AttrTest(op, tuple(value.split(",")) if op == "subset_of" else value)


@dataclass(frozen=True)
class Engine:
    corpus: Corpus
    root: str = "."
    repository: revisions.Repository | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str = ".", as_of: str | None = None, at: str | None = None, config: str | None = None, folder: str | None = None) -> Engine:
        """The corpus below a folder: its work tree, or a revision of it (at)."""
        cfg, base = discovery.resolve(root, config, folder)
        try:
            repository = revisions.Repository(root)
        except (revisions.RevisionError, FileNotFoundError):
            repository = None
        day = discovery.as_of(as_of, repository)
        if at is None:
            return cls(markdown.load(spark, base, cfg, day), base, repository)
        if repository is None:
            raise ConfigError("a revision needs a repository")
        found = repository.corpus(spark, at, cfg, day)
        if found.nodes.limit(1).count() == 0:
            raise ValueError(f"no document at {at}")
        return cls(found, base, repository)

    @cached_property
    def ready(self) -> Corpus:
        """The corpus with what all answers share written once: periods, weighing edges, and the frame of conditions."""
        return self.corpus.prepared()

    def need_supersedes(self) -> None:
        if self.corpus.cfg.edge("supersedes") is None:
            raise ConfigError("this needs an edge supersedes")

    def findings(self, touching: list[str] | None = None, suppressed: bool = False, fixes: bool = True, since: str | None = None) -> DataFrame:
        """All findings; of touched files alone, if named; with those of append-only history, if a revision is given."""
        c = self.ready
        rows = checks.findings(c)
        if c.documents is not None and any(k.sections for _, k in c.cfg.kind_items()):
            rows = rows.unionByName(markdown.section_findings(c))
        if since is not None:
            if self.repository is None:
                raise ConfigError("history needs a repository")
            base = self.repository.snapshot(c.spark, self.repository.merge_base(since), c.cfg)
            rows = rows.unionByName(revisions.append_only(base, markdown.read_files(c.spark, self.root, c.cfg), c.cfg))
        rows = rows if suppressed else rows.where("NOT suppressed")
        if touching:
            rows = checks.touching(c, rows, touching)
        return checks.with_fixes(c, stored(rows)) if fixes else rows

    def validate(self, how: str = "text", **options) -> tuple[Iterator[str], int]:
        """A report of all findings in order, and the exit status."""
        rows = stored(self.findings(**options))
        total = checks.summary(self.ready, rows.drop("fix") if "fix" in rows.columns else rows).first().asDict()
        head = {"preset_version": self.corpus.cfg.revision, "as_of": self.corpus.as_of}
        return reports.written(rows, how, total, **head), exit_status(total)

    def lint(self, fixtures: Mapping | None = None, base: Corpus | None = None, inherent_only: bool = False) -> list[LintFinding]:
        """Findings on the configuration: by itself, and against the corpus and fixtures."""
        found = lint(self.corpus.cfg)
        if inherent_only:
            return found
        firable: set[str] = set()
        if fixtures is not None:
            own, firable = lint_corpus.check_fixtures(fixtures, self.corpus.cfg)
            found += own
        return found + lint_corpus.findings(self.ready, firable, base)

    def resolve(self, refs: Iterable[str]) -> tuple[DataFrame, DataFrame]:
        """ref, id of where each lineage leads; and what was met but not followed."""
        self.need_supersedes()
        asked = stored(self.asked(refs))
        ends, pending = graph.resolve(self.ready, asked.select("id").distinct())
        named = asked.withColumnRenamed("id", "start")
        return named.join(ends, "start").select("ref", "id"), named.join(pending, "start").select("ref", "id", "predecessor", "reason")

    def asked(self, refs: Iterable[str]) -> DataFrame:
        """ref and id of references to known documents."""
        c = self.corpus
        rows = c.spark.createDataFrame([(r,) for r in refs], "ref string").withColumn("id", normalised(F.col("ref"), c.cfg))
        return rows.join(c.nodes.select("id"), "id", "left_semi").select("ref", "id")

    def where(self, tests: Iterable[str] = ()) -> DataFrame:
        """The frame's rows that meet all filters; keys are the status, declared fields, projections and in_force."""
        c = self.ready
        allowed = {c.cfg.status_field, IN_FORCE, *c.projections, *(n for _, n, _ in checks.declared_fields(c))}
        rows = c.frame
        for text in tests:
            key, test = parse_test(text)
            if key not in allowed:
                raise ConfigError(f"no filter on {key}; there are {', '.join(sorted(allowed))}")
            rows = rows.where(attr_column(key, test, c.projections))
        return rows

    def query(self, refs: Iterable[str], direction: str = "descendants", types: list[str] | None = None, references: bool = False, tests: Iterable[str] = ()) -> DataFrame:
        """ref, id, layer of what each reference reaches, or of its neighbours by references."""
        c, asked = self.ready, stored(self.asked(refs))
        if references:
            near = graph.neighbours(c, asked.select("id").distinct())
        else:
            walk = {"descendants": graph.descendants, "ancestors": graph.ancestors}[direction]
            near = walk(c, asked.select("id").distinct(), types).withColumn("layer", F.lit("typed"))
        if tests := list(tests):
            near = near.join(self.where(tests).select("id"), "id", "left_semi")
        return asked.withColumnRenamed("id", "start").join(near, "start").select("ref", "id", "layer")

    def binding(self, tests: Iterable[str] = ()) -> DataFrame:
        self.need_supersedes()
        rows = self.ready.binding
        return rows.join(self.where(tests).select("id"), "id", "left_semi") if (tests := list(tests)) else rows

    def listing(self, ids: DataFrame, fields: Iterable[str] = ("id",), how: str = "text") -> DataFrame:
        """id and text of each record.  JSON tells every projection and declared field, whatever fields are named."""
        c = self.ready
        keys = sorted({n for _, n, _ in checks.declared_fields(c)})
        marked = "layer" in ids.columns
        what = c.frame.select("id", "title", "status", "path", "scalars", "lists", *(f"is_{p}" for p in c.projections))
        rows = ids.join(what, "id", "left")
        text = reports.record_json(c.projections, keys, marked) if how == "json" else reports.record_line(fields, c.projections, keys, marked)
        return rows.withColumn("text", text).select(*ids.columns, "text")

    def context(self, refs: Iterable[str], how: str = "text", budget: int = briefs.BUDGET, **options) -> DataFrame:
        """start and text of each brief."""
        asked = self.asked(refs).select("id").distinct()
        told = stored(briefs.briefs(self.ready, asked, budget, **options))
        return briefs.brief_json(told, budget) if how == "json" else briefs.outlines(told, how, budget)

    def export(self, how: str = "mermaid", **options) -> Iterator[str]:
        return export.written(self.corpus, how, **options)

    def stats(self) -> dict:
        """All statistics; each part has as many rows as the configuration or a report has, but for topics, which are asked for in a corpus of topics."""
        self.need_supersedes()
        c = self.ready
        alone = stats.orphans(c).first()
        out = {
            "documents": alone["documents"],
            "binding": c.binding.count(),
            "orphans": alone["orphans"],
            "orphan_rate": alone["rate"],
            "edges": [{"type": r["type"], "count": r["n"]} for r in stats.edge_counts(c).orderBy("place").collect()],
            "chain_depth": [{"depth": r["depth"], "count": r["n"]} for r in stats.depth_histogram(c).orderBy("depth").collect()],
            "top_referenced": [{"id": r["id"], "count": r["n"]} for r in stats.most_referenced(c).collect()],
        }
        if c.cfg.edge("about") is not None:
            found = stats.suppressed_conflicts(c).first()
            out["topics"] = [{"topic": r["id"], "clauses": r["n"]} for r in stats.clauses_by_topic(c).orderBy("id").toLocalIterator()]
            out["modalities"] = [{"modality": r["modality"], "count": r["n"]} for r in stats.modalities(c).orderBy("modality").collect()]
            out["suppressed_conflicts"] = found["suppressed"]
        return out

    def field_usage(self) -> DataFrame:
        days = None
        if self.repository is not None:
            cfg = self.corpus.cfg
            days = self.repository.last_changed(self.corpus.spark, [k.dir if cfg.multikind else cfg.dir for _, k in cfg.kind_items()])
        return stats.field_usage(self.corpus, days)

    def diff(self, revision: str) -> tuple[DataFrame, str]:
        """Lines of all differences from a revision, and that on the binding set."""
        if self.repository is None:
            raise ConfigError("a revision needs a repository")
        c = self.ready
        base = self.repository.corpus(c.spark, revision, c.cfg, c.as_of).prepared()
        n = history.binding_delta(base, c).first()
        return reports.change_lines(history.document_changes(base, c), history.edge_changes(base, c)), reports.binding_line(n["before"], n["after"])

    def plan_new(self, title: str, date: str | None = None, **how) -> newdoc.Plan:
        request = newdoc.Request(title, date or discovery.as_of(), **how)
        return newdoc.plan(self.corpus, self.root, request)

    def at(self, day: str) -> Engine:
        return replace(self, corpus=self.corpus.at(day))
