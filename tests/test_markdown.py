import pytest

from tracewright.operators import checks, graph
from tracewright.plans.config import Config, ConfigError, load, presets, read
from tracewright.sources import markdown

DAY = "2026-06-01"


def files(spark, texts, kind="document"):
    rows = [(f"docs/{n}", kind, t.encode()) for n, t in texts.items()]
    return spark.createDataFrame(rows, "path string, kind string, content binary")


def doc(status="accepted", body="# Context\n", **keys):
    lines = "".join(f"{k.replace('_', '-')}: {v}\n" for k, v in keys.items())
    return f"---\ntitle: T\nstatus: {status}\n{lines}---\n{body}"


def found(corpus, *names):
    """Findings of the build and of the checks named."""
    rows = checks.union(corpus, [corpus.build_findings, *(checks.CHECKS[n](corpus) for n in names)]).collect()
    return sorted(((r.rule, r.id, r.line) for r in rows), key=str)


def adr(spark, texts, cfg=None):
    return markdown.build(files(spark, texts), cfg or presets()["adr"], DAY)


def test_clean_corpus(spark):
    c = adr(spark, {"0001-a.md": doc("superseded"), "0002-b.md": doc(supersedes="[0001]"), "000003.md": doc(depends_on="[ADR-2, '[[0001|x]]']")})
    assert found(c, "rules", "dangling_ref") == []
    assert sorted((e.src, e.dst, e.type) for e in c.edges.collect()) == [("0002", "0001", "supersedes"), ("0003", "0001", "depends-on"), ("0003", "0002", "depends-on")]
    start = c.spark.createDataFrame([("0003",)], "id string")
    assert sorted(r.id for r in graph.descendants(c, start).collect()) == ["0001", "0002"]


@pytest.mark.parametrize(
    ("texts", "names", "expected"),
    [
        ({"0001-a.md": doc("superseded"), "0002-b.md": doc()}, ["rules"], [("superseded_orphan", "0001", 3)]),
        ({"0001-a.md": doc(), "0002-b.md": doc(supersedes="[0001]")}, ["rules"], [("status_drift", "0001", 3)]),
        ({"0001-a.md": doc(supersedes="[0009]")}, ["dangling_ref"], [("dangling_ref", "0001", 4)]),
        ({"0001-a.md": doc(supersedes="[see 0001]")}, [], [("invalid_ref", "0001", 4)]),
        ({"0001-a.md": doc(supersedes="", depends_on="[]")}, [], [("empty_edge", "0001", 4), ("empty_edge", "0001", 5)]),
        ({"0001-a.md": "---\nstatus: [\n---\n", "0002-b.md": "no block"}, [], [("invalid_frontmatter", "0001", 3), ("missing_frontmatter", "0002", 1)]),
        ({"0001-a.md": "---\nstatus: accepted\nstatus: accepted\n---\n"}, [], [("invalid_frontmatter", "0001", 3)]),
        ({"0001-a.md": doc(), "0001-b.md": doc(), "0002-c.md": doc()}, ["id_collision"], [("id_collision", "0001", 1)]),
        ({"0001-a.md": doc("unheard-of")}, ["unknown_status"], [("unknown_status", "0001", 3)]),
        ({"0001-a.md": doc(), "notes.md": "x", "README.md": "x"}, [], [("unmanaged_file", None, 1)]),
        ({"0001-a.md": doc(supersedes="[0002]"), "0002-b.md": doc("superseded", supersedes="[0003]"), "0003-c.md": doc("superseded", supersedes="[0001]")}, ["cycle", "rules"], [("cycle", "0001", 4), ("status_drift", "0001", 3)]),
        ({"0001-a.md": doc("superseded by 0002"), "0002-b.md": doc()}, ["unstructured_supersedes"], [("unstructured_supersedes", "0001", 3)]),
        ({"0001-a.md": doc(retracts="[{from: '0001', edge: supersedes, to: '0002'}]")}, [], [("invalid_retraction", "0001", 4)]),
    ],
)
def test_findings(spark, texts, names, expected):
    assert found(adr(spark, texts), *names) == expected


def test_derived_conflict(spark):
    c = adr(spark, {"0001-a.md": doc(), "0002-b.md": doc("superseded by 0001", supersedes="[0001]")})
    assert ("derived_conflict", "0002", 3) in found(c, "derived_conflict")


def test_retraction_takes_effect_from_accepted_documents(spark):
    texts = {"0001-a.md": doc("superseded"), "0002-b.md": doc(supersedes="[0001]")}
    for status, left in (("accepted", 0), ("proposed", 1)):
        c = adr(spark, {**texts, "0003-c.md": doc(status, retracts="[{from: 2, edge: supersedes, to: 1}]")})
        assert c.edges.count() == left, status


def test_kinds_attributes_and_padding(spark):
    cfg = presets()["spec"]
    clause = lambda **k: doc(modality="MUST", about="[topic/a]", **k)
    rows = [
        ("spec/clauses/UZ-V-001.md", "clause", clause().replace("status: accepted", "status: superseded")),
        ("spec/clauses/UZ-V-002.md", "clause", clause(supersedes="[{ref: UZ-V-001, reason: whim, more: x}]")),
        ("spec/clauses/UZ-V-003.md", "clause", clause(supersedes="[UZ-V-01]", surplus="x")),
        ("spec/clauses/README.md", "clause", "x"),
        ("spec/topics/a.md", "topic", "---\nid: topic/a\nkind: clause\n---\n"),
    ]
    c = markdown.build(spark.createDataFrame([(p, k, t.encode()) for p, k, t in rows], "path string, kind string, content binary"), cfg, DAY)
    got = found(c, "edge_attr_invalid", "edge_attr_unknown", "unknown_field", "kind_mismatch")
    assert set(got) >= {("edge_attr_invalid", "UZ-V-002", 6), ("edge_attr_unknown", "UZ-V-002", 6), ("padding_mismatch", "UZ-V-003", 6), ("unknown_field", "UZ-V-003", 7), ("kind_mismatch", "topic/a", 3), ("id_mismatch", None, 1)}


def test_sections(spark):
    cfg = load("preset: adr\nordered_sections: true\nsections:\n- Context\n- heading: Decision|Outcome\n  level: 2\n- Consequences\n")
    c = adr(spark, {"0001-a.md": doc(body="## Context\n## Outcome:\n## Consequences\n"), "0002-b.md": doc(body="# Consequences\n```\n## Decision\n```\n# Context\n")}, cfg)
    rows = sorted((r.rule, r.id, r.line) for r in markdown.section_findings(c).collect())
    assert rows == [("missing_section", "0002", 1), ("section_order", "0002", 9)]


def test_links_skip_code(spark):
    body = "See [[0002]] and [c](0003-c.md#x) and `[[0004]]`.\n~~~\n[[0005]]\n~~~\n[web](https://e.org/0006.md)\n"
    cfg = read({"references": {"dangling": "error"}})
    c = adr(spark, {"0001-a.md": doc(body=body), "0002-b.md": doc()}, cfg)
    assert sorted(r.dst for r in c.refs.collect()) == ["0002", "0003"]
    assert found(c, "dangling_reference") == [("dangling_reference", "0001", 1)]


def test_numbers_stay_text():
    fm, lines = markdown.decode("a: 0011\nb: 1_000\nc: 2026-01-02\nd: true\ne: null\nf: [01, 02]\n")
    assert (fm["a"], fm["b"], fm["c"], fm["d"], fm["e"], fm["f"]) == ("0011", "1_000", "2026-01-02", True, None, ["01", "02"])
    assert lines["f"] == 7


def test_folder(spark, tmp_path):
    (tmp_path / "docs/adr").mkdir(parents=True)
    (tmp_path / "docs/adr/0001-a.md").write_bytes("﻿---\r\nstatus: accepted\r\n---\r\nx".encode())
    assert [r.id for r in markdown.load(spark, str(tmp_path), presets()["adr"], DAY).nodes.collect()] == ["0001"]
    with pytest.raises(ValueError):
        markdown.load(spark, str(tmp_path / "none"), presets()["adr"], DAY)


@pytest.mark.parametrize("raw", [{"surplus": 1}, {"rules": [{"name": "x", "when": {}}]}, {"rules": [{"name": "x", "when": {"inbound": "nothing"}}]}, {"rules": [{"name": "x", "when": {"inbound": {"edge": "supersedes", "max": 0}}}]}, {"projections": [{"name": "a", "when": {"attr": {"b": {"eq": "true"}}}}, {"name": "b", "when": {"attr": {"a": {"eq": "true"}}}}], "binding": "a"}])
def test_bad_configurations(raw):
    with pytest.raises(ConfigError):
        read(raw)


def test_presets_are_valid():
    assert set(presets()) == {"adr", "spec"} and isinstance(presets()["spec"], Config)
    assert len(presets()["spec"].kinds) == 8 and len(presets()["spec"].edges) == 10


def test_lines_end_at_line_feeds_alone():
    links, headings = markdown.scan("a\x0cb\u2028c\r\n# Two\r\n``` a`b\n[[0002]]\n````\n[[0003]]\n```\n[[0004]]\n`````  \n[[0005]]", 1)
    assert [(h[1], h[2]) for h in headings] == [("Two", 2)]
    assert [(x[0], x[2]) for x in links] == [("0002", 4), ("0005", 10)]
    assert markdown.split_block("---\na: b\x0cc\n---\nx") == ("a: b\x0cc\n", "x", 4)
