"""States of a corpus in a git repository, and what changed between them.

git runs on the driver, once for each answer; the contents of a revision come from one archive.
"""

from __future__ import annotations

import io
import subprocess
import tarfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.checks import STANDARD
from tracewright.operators.corpus import Corpus
from tracewright.operators.history import CLOSED
from tracewright.plans.config import Config
from tracewright.scratch import stored
from tracewright.sources import markdown


class RevisionError(ValueError):
    """A revision or repository that can't be read."""


class Repository:
    def __init__(self, root: str):
        self.root = self._git(root, "rev-parse", "--show-toplevel").decode().strip()

    @staticmethod
    def _git(root: str, *words: str) -> bytes:
        ran = subprocess.run(["git", "-C", root, *words], capture_output=True)  # noqa: S603, S607
        if ran.returncode:
            raise RevisionError(ran.stderr.decode(errors="replace").strip() or f"git {words[0]} failed")
        return ran.stdout

    def git(self, *words: str) -> bytes:
        return self._git(self.root, *words)

    def names(self, *words: str) -> list[str]:
        """NUL-separated names."""
        return [n for n in self.git(*words).decode().split("\0") if n]

    def merge_base(self, revision: str) -> str:
        """Where the current state and a revision part; the revision itself where they share nothing."""
        try:
            return self.git("merge-base", revision, "HEAD").decode().strip()
        except RevisionError:
            return revision

    def committer_day(self, revision: str = "HEAD") -> str:
        return self.git("show", "-s", "--format=%cs", revision).decode().strip()

    def files(self, revision: str, folder: str = ".") -> list[str]:
        return self.names("ls-tree", "-r", "-z", "--name-only", "--full-tree", revision, "--", folder)

    def file(self, revision: str, path: str) -> bytes:
        return self.git("show", f"{revision}:{path}")

    def changes(self, base: str, folder: str = ".") -> list[tuple[str, str]]:
        """op (A, M, D; moves count as both) and path of what differs from base in the work tree."""
        parts = self.names("diff", "--name-status", "--no-renames", "-z", base, "--", folder)
        return [(op[0], path) for op, path in zip(parts[::2], parts[1::2], strict=True)]

    def untracked(self, folder: str = ".") -> list[str]:
        return self.names("ls-files", "--others", "--exclude-standard", "-z", "--", folder)

    def last_changed(self, spark: SparkSession, folders: Iterable[str]) -> DataFrame:
        """path and day of its last commit, from one walk of the log."""
        rows, day = [], ""
        for name in self.names("log", "--format=%x00day:%cs", "--name-only", "-z", "--", *folders):
            for part in filter(None, name.split("\n")):
                if part.startswith("day:"):
                    day = part[4:]
                else:
                    rows.append((part, day))
        return spark.createDataFrame(rows, "path string, day string").groupBy("path").agg(F.max("day").alias("day"))

    def contents(self, revision: str, folders: Iterable[str]) -> list[tuple[str, bytes]]:
        there = [f for f in folders if self.files(revision, f)]
        if not there:
            return []
        with tarfile.open(fileobj=io.BytesIO(self.git("archive", "--format=tar", revision, "--", *there))) as tar:
            return [(m.name, tar.extractfile(m).read()) for m in tar.getmembers() if m.isfile()]

    def snapshot(self, spark: SparkSession, revision: str, cfg: Config) -> DataFrame:
        """path, kind and content of a revision's Markdown files in the folders of a configuration."""
        folders = {(k.dir if cfg.multikind else cfg.dir).strip("/"): kind for kind, k in cfg.kind_items()}
        rows = [(p, folders[p.rpartition("/")[0]], c) for p, c in self.contents(revision, folders) if p.endswith(".md") and p.rpartition("/")[0] in folders]
        return spark.createDataFrame(rows, "path string, kind string, content binary")

    def corpus(self, spark: SparkSession, revision: str, cfg: Config, as_of: str) -> Corpus:
        return markdown.build(self.snapshot(spark, revision, cfg), cfg, as_of)


def append_only(base: DataFrame, target: DataFrame, cfg: Config) -> DataFrame:
    """Findings on closed documents that changed otherwise than history allows.

    base and target: path, kind, content.  A document that was accepted, superseded or withdrawn may change its
    status, get more references under mirrored and appendable keys, and get text at its end.  With kinds, only those declared
    append-only are looked at.  A file that is the same in both states is neither parsed nor told of.
    """
    kinds = [k for k, v in cfg.kind_items() if v.append_only] if cfg.multikind else None
    a, b = ((f if kinds is None else f.where(F.col("kind").isin(kinds))).select("path", "kind", "content") for f in (base, target))
    differing = stored(a.join(b.toDF("path", "now_kind", "now_content"), "path", "left").where(~(F.col("content").eqNullSafe(F.col("now_content")) & F.col("kind").eqNullSafe(F.col("now_kind")))))
    was = markdown.documents(differing.select("path", "kind", "content").distinct(), cfg).where("id IS NOT NULL")
    now = markdown.documents(differing.where("now_kind IS NOT NULL").select("path", F.col("now_kind").alias("kind"), F.col("now_content").alias("content")).distinct(), cfg).where("id IS NOT NULL")
    status = markdown.canonical_status(F.coalesce(markdown.value(cfg.status_field), F.lit("")), cfg)
    closed = was.where(F.lower(status).isin(*CLOSED) & F.col("error").isNull()).select("path", "id", F.from_json("fm", "map<string,string>").alias("old"), F.col("body").alias("old_body"))
    new = now.select("path", F.from_json("fm", "map<string,string>").alias("new"), F.col("body").alias("new_body"), "key_lines", "body_line", F.col("error").alias("bad"), F.lit(True).alias("there"))
    both = stored(closed.join(new, "path", "left")).withColumn("line", F.lit(1))
    severity = cfg.severity("immutable_violation", STANDARD["immutable_violation"])

    def told(rows: DataFrame, detail, line) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.lit("immutable_violation").alias("rule"), "id", detail.alias("detail"), "path", line.cast("int").alias("line"), F.array().cast("array<string>").alias("related"), F.lit(False).alias("suppressed"))

    one = F.lit(1)
    gone = told(both.where("there IS NULL"), F.lit("is gone"), one)
    broken = told(both.where("bad IS NOT NULL"), F.lit("can no longer be read"), one)
    kept = both.where("there AND bad IS NULL")
    mirrored = [k for e in cfg.edges for k in (e.inverse, e.key if e.appendable else None) if k]
    keys = kept.select("id", "path", "key_lines", "old", "new", F.explode(F.array_union(F.map_keys("old"), F.map_keys("new"))).alias("key")).where(F.col("key") != cfg.status_field)
    keys = keys.withColumns({"was": F.try_element_at("old", F.col("key")), "now": F.try_element_at("new", F.col("key"))}).where(~F.col("was").eqNullSafe(F.col("now")))

    def listed(c: str):
        return F.coalesce(F.from_json(F.when(F.col(c).rlike(markdown.LISTED), F.col(c)), "array<string>"), F.when(F.col(c).isNotNull(), F.array(c)), F.array().cast("array<string>"))

    lost = F.array_except(listed("was"), listed("now"))
    grows = F.col("key").isin(*mirrored) if mirrored else F.lit(False)
    verb = F.when(F.col("now").isNull(), "is removed").when(F.col("was").isNull(), "is added").otherwise("is changed")
    at = F.coalesce(F.try_element_at("key_lines", F.col("key")), one)
    changed = told(keys.where(~grows), F.concat(F.lit("key "), F.col("key"), F.lit(" "), verb), at)
    shrunk = told(keys.where(grows & (F.size(lost) > 0)), F.concat(F.col("key"), F.lit(" no longer lists "), F.array_join(lost, ", ")), at)
    old, new_lines = (F.transform(F.split(F.regexp_replace(c, r"[ \t\r\n]+$", "") if c == "old_body" else F.col(c), "\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r$", ""))) for c in ("old_body", "new_body"))
    texts = kept.where(F.trim(F.regexp_replace("old_body", r"\s", "")) != "").withColumns({"a": old, "b": new_lines})
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda i: ~F.coalesce(F.get("a", i) == F.get("b", i), F.lit(False))), True)
    bent = texts.withColumn("at", first.cast("int")).where("at > 0")
    body = told(bent, F.format_string("text changes at line %d", F.col("body_line") + F.col("at") - 1), F.col("body_line") + F.col("at") - 1)
    return gone.unionByName(broken).unionByName(changed).unionByName(shrunk).unionByName(body)


