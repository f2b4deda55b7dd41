"""Whole commands over documents in a repository: validation, history, new documents, briefs, listings, exports."""

import json
import subprocess

import pytest

from tracewright.api import Engine, exit_status, lint_status, parse_test
from tracewright.operators import briefs
from tracewright.outputs import reports
from tracewright.plans import discovery
from tracewright.plans.config import AttrTest, ConfigError, presets
from tracewright.plans.discovery import discover
from tracewright.sources import newdoc
from tracewright.sources.revisions import Repository


def record(title, status="accepted", body="## Decision\n\nWe do it.\n", **keys):
    more = "".join(f"{k.replace('_', '-')}: {v}\n" for k, v in keys.items())
    return f"---\ntitle: {title}\nstatus: {status}\ndate: 2026-01-0{len(title) % 9 + 1}\n{more}---\n\n# {title}\n\n{body}"


def git(root, *words):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b.c", *words], check=True, capture_output=True)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")
    docs = top / "docs/adr"
    docs.mkdir(parents=True)
    (docs / "0001-one.md").write_text(record("One", "superseded"))
    (docs / "0002-two.md").write_text(record("Two", supersedes="[0001]", body="## Context\n\nIt rests on [[3]].\n\n## Decision Outcome\n\nTwo it is.\nReally.\n\nMore.\n"))
    (docs / "0003-three.md").write_text(record("Three", depends_on="[0002]"))
    git(top, "init", "-q")
    git(top, "add", "-A")
    git(top, "commit", "-q", "-m", "first", "--date", "2026-03-01T00:00:00")
    git(top, "tag", "before")
    (docs / "0001-one.md").write_text(record("One", "superseded", body="## Decision\n\nWe did it.\n"))
    (docs / "0003-three.md").write_text(record("Three", depends_on="[0002, 0009]"))
    (docs / "0004-four.md").write_text(record("Four", "decided"))
    return top


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine.open(spark, str(root), as_of="2026-06-01")


def test_validate(engine):
    lines, status = engine.validate()
    lines = list(lines)
    assert status == 1
    assert lines[0].startswith("docs/adr/0003-three.md:5: ERROR dangling_ref 0003: ") and lines[0].endswith("fix: did you mean 0004, 0002 or 0001?")
    assert lines[1].startswith("docs/adr/0004-four.md:3: ERROR unknown_status 0004") and lines[-1] == "as of 2026-06-01"
    whole = json.loads("".join(engine.validate("json")[0]))
    assert whole["schema_version"] == 2 and whole["summary"]["documents"] == 4 and [f["rule"] for f in whole["findings"]] == ["dangling_ref", "unknown_status"]
    diagnostics = json.loads("".join(engine.validate("rdjson")[0]))
    assert diagnostics["severity"] == "ERROR" and len(diagnostics["diagnostics"]) == 2
    only = [r.id for r in engine.findings(touching=["docs/adr/0004-four.md"]).collect()]
    assert only == ["0004"]


def test_history(engine):
    rows = sorted((r.id, r.detail, r.line) for r in engine.findings(since="before", fixes=False).where("rule = 'immutable_violation'").collect())
    assert rows == [("0001", "text changes at line 11", 11), ("0003", "key depends-on is changed", 5)]
    lines, binding = engine.diff("before")
    assert [r.text for r in lines.collect()] == ["+ depends-on 0003 -> 0009", "+ document   0004 [decided]"]
    assert binding == "binding: 2 -> 2 (0)"


def test_revisions(spark, root):
    repo = Repository(str(root))
    assert repo.files("before", "docs/adr") == [f"docs/adr/{n}.md" for n in ("0001-one", "0002-two", "0003-three")]
    assert sorted(repo.changes("before")) == [("M", "docs/adr/0001-one.md"), ("M", "docs/adr/0003-three.md")]
    assert repo.untracked() == ["docs/adr/0004-four.md"]
    assert b"We do it" in repo.file("before", "docs/adr/0001-one.md")
    assert len(repo.committer_day()) == 10 and repo.merge_base("before")
    assert repo.last_changed(spark, ["docs/adr"]).count() == 3
    then = Engine.open(spark, str(root), as_of="2026-06-01", at="before")
    assert sorted(r.id for r in then.corpus.nodes.collect()) == ["0001", "0002", "0003"]
    with pytest.raises(ValueError):
        Engine.open(spark, str(root), at="nowhere")


def test_queries_and_listings(engine):
    ends, _ = engine.resolve(["1", "nothing"])
    assert [tuple(r) for r in ends.collect()] == [("1", "0002")]
    near = engine.query(["0003"])
    assert sorted(r.id for r in near.collect()) == ["0001", "0002"]
    assert [r.id for r in engine.query(["0003"], tests=["status=accepted"]).collect()] == ["0002"]
    rows = engine.listing(near, ["id", "title", "accepted_unsuperseded"]).orderBy("id").collect()
    assert [r.text for r in rows] == ["0001\tOne\tfalse", "0002\tTwo\ttrue"]
    told = json.loads(engine.listing(near, how="json").orderBy("id").first().text)
    assert told["path"] == "docs/adr/0001-one.md" and told["projections"] == {"accepted_unsuperseded": "false"}
    assert {r.id for r in engine.query(["0002"], references=True).collect()} == {"0001", "0003"}
    assert sorted(r.id for r in engine.binding().collect()) == ["0002", "0003"]
    with pytest.raises(ConfigError):
        engine.where(["colour=eq:red"])
    assert parse_test("a=not:b") == ("a", AttrTest("not", "b")) and parse_test("a=b:c") == ("a", AttrTest("eq", "b:c")) and parse_test("a=subset_of:x,y")[1].value == ("x", "y")


def test_context(engine):
    text = engine.context(["0002"]).first().text
    assert text.split("\n") == ["ref", "  0002  Two  [accepted]  docs/adr/0002-two.md", "    Two it is.", "    Really.", "", "ancestors", "  0003  Three  [accepted]  docs/adr/0003-three.md", "    We do it."]
    small = engine.context(["0002"], budget=30).first().text
    assert "We do it" not in small and small.endswith("1 without an excerpt")
    told = json.loads(engine.context(["0002"], "json").first().text)
    assert told["ref"]["excerpt"] == "Two it is.\nReally." and [e["id"] for e in told["ancestors"]] == ["0003"] and told["budget"]["degraded"] == 0
    assert engine.context(["0002"], "markdown").first().text.startswith("# 0002 Two\n")


def test_excerpts():
    assert briefs.excerpt("## Decisions\na\n## Decision ##\n\n\nb\nc\n\nd", "Decision") == "b\nc"
    assert briefs.excerpt("```\n## Decision\n```\n# Decision\nno\n") == "" and briefs.excerpt(None) == ""
    assert briefs.excerpt("### decision outcome\n# next") == ""


def test_export(engine):
    assert list(engine.export("mermaid", connected=True)) == ["graph LR", '  0001["0001 One"]', '  0002["0002 Two"]', '  0003["0003 Three"]', "  0002 -->|supersedes| 0001", "  0003 -->|depends-on| 0002"]
    whole = json.loads("".join(engine.export("json", references=True)))
    assert len(whole["nodes"]) == 4 and [e["type"] for e in whole["links"]] == ["supersedes", "depends-on", "references"]
    assert list(engine.export("dot", types=["supersedes"], connected=True))[-2] == '  "0002" -> "0001" [label="supersedes"];'


def test_statistics(engine):
    told = engine.stats()
    assert (told["documents"], told["binding"], told["orphans"]) == (4, 2, 1)
    assert told["edges"] == [{"type": "supersedes", "count": 1}, {"type": "depends-on", "count": 2}]
    lines = reports.stats_lines(told)
    assert lines[0].split() == ["documents", "4"] and "orphans" in lines[2] and "25.0%" in lines[2]
    assert {r.key: r.documents for r in engine.field_usage().collect()}["supersedes"] == 1
    found = {(f.rule, f.id) for f in engine.lint()}
    assert ("never_fired", "status_drift") in found and ("never_fired", "superseded_orphan") in found


def test_new_documents(engine, root, tmp_path):
    plan = engine.plan_new("Use a new Thing!", "2026-07-01", edges={"supersedes": ["2"]})
    assert plan.told() == {"id": "0005", "path": "docs/adr/0005-use-a-new-thing.md", "exists": False, "rewrites": [{"path": "docs/adr/0002-two.md", "status": "superseded"}]}
    assert reports.plan_lines(plan.told(), "status") == ["create 0005 docs/adr/0005-use-a-new-thing.md", "rewrite docs/adr/0002-two.md status: superseded"]
    assert plan.content.startswith(b'---\ntitle: Use a new Thing!\nstatus: proposed\ndate: 2026-07-01\nsupersedes:\n  - "0002"\n---\n')
    (tmp_path / "docs/adr").mkdir(parents=True)
    for f in (root / "docs/adr").iterdir():
        (tmp_path / "docs/adr" / f.name).write_bytes(f.read_bytes())
    assert newdoc.apply(plan, str(tmp_path)) == plan.path
    assert (tmp_path / "docs/adr/0002-two.md").read_bytes() == (root / "docs/adr/0002-two.md").read_bytes().replace(b"status: accepted", b"status: superseded")
    with pytest.raises(FileExistsError):
        newdoc.apply(plan, str(tmp_path))
    assert engine.plan_new("Two", "2026-07-01", id="2").exists
    for bad in ({"id": "2"}, {"edges": {"supersedes": ["77"]}}, {"kind": "clause"}):
        with pytest.raises(ConfigError):
            engine.plan_new("Another", "2026-07-01", **bad)


def test_new_document_parts():
    assert newdoc.slug("Ünïcode & Co., 2!") == "ünïcode-co-2" and newdoc.file_name(presets()["adr"], "", "0007", "!!") == "0007.md"
    assert newdoc.with_status(b"---\r\na: 1\r\n---\r\nstatus: x", "status", "y") == b"---\r\na: 1\r\nstatus: y\r\n---\r\nstatus: x"
    spec = presets()["spec"]
    assert newdoc.field_rows(spec, "clause") == "# modality: <MUST|MUST_NOT|SHOULD|SHOULD_NOT|MAY>\n"
    rows = newdoc.edge_rows(spec, newdoc.Request("t", "2026-01-01", kind="clause"), {})
    assert "# supersedes:\n#   - {ref: <clause|premise>, reason: <correction|evolution|withdrawal>}\n" in rows and "enforces" not in rows


def test_discovery(tmp_path, monkeypatch):
    with pytest.raises(ConfigError):
        discover(tmp_path)
    (tmp_path / "doc/adr").mkdir(parents=True)
    (tmp_path / "doc/adr/README.md").write_text("x")
    (tmp_path / "adr").mkdir()
    (tmp_path / "adr/0001-x.md").write_text("x")
    assert discover(tmp_path) == "adr"
    (tmp_path / "tracewright.yaml").write_text("dir: doc/adr\nstatus_values: [open]\n")
    cfg, base = discovery.resolve(tmp_path)
    assert (cfg.dir, cfg.statuses, base) == ("doc/adr", ("open",), str(tmp_path))
    assert discovery.resolve(tmp_path, folder="adr")[0].dir == "adr"
    for bad in ({"path": "none.yaml"}, {"folder": "none"}):
        with pytest.raises(ConfigError):
            discovery.resolve(tmp_path, **bad)
    assert discovery.as_of("2026-02-28") == "2026-02-28"
    monkeypatch.setenv(discovery.DAY_VARIABLE, "2026-01-31")
    assert discovery.as_of() == "2026-01-31"
    with pytest.raises(ConfigError):
        discovery.as_of("2026-02-30")


def test_statuses():
    assert exit_status({"errors": 0}) == 0 and exit_status({"errors": 2}) == 1
    assert [lint_status({"errors": e, "warnings": w}) for e, w in ((0, 0), (0, 1), (1, 1))] == [0, 2, 1]
    assert reports.closing({"errors": 0, "documents": 3, "edges": 2}, "2026-01-01") == "OK: 3 docs, 2 typed edges, no cycles, as of 2026-01-01"
    assert reports.lint_closing({"errors": 0, "warnings": 0, "infos": 0}) == "OK: no lint findings"
    assert reports.lint_closing({"errors": 1, "warnings": 2, "infos": 1}) == "1 error, 2 warnings, 1 info"
