"""Analysis of configurations without documents, and fixtures made from rules."""

import re

import pytest

from tracewright.operators import lint_corpus
from tracewright.plans import lint
from tracewright.plans.config import Condition, Config, ConfigError, presets, read
from tracewright.sources import fixtures


def names(raw):
    return {(f.rule, f.id) for f in lint.lint(read(raw, Config()))}


EDGES = [{"name": "supersedes", "max_inbound": 2}]


@pytest.mark.parametrize(
    ("when", "rule"),
    [
        ({"attr": {"a": {"eq": "x"}, "b": {"eq": "y"}}, "not": {"attr": {"a": {"eq": "X"}}}}, "unfirable_rule"),
        ({"inbound": "supersedes", "not_inbound": "supersedes"}, "unfirable_rule"),
        ({"not_outbound": "supersedes", "via": {"edge": "supersedes", "attr": {"a": {"eq": "x"}}}}, "unfirable_rule"),
        ({"inbound": {"edge": "supersedes", "min": 3}}, "unfirable_rule"),
        ({"attr": {"status": {"eq": "gone"}}}, "unfirable_rule"),
        ({"via": {"edge": "supersedes", "attr": {"status": {"eq": "gone"}}}}, "unfirable_rule"),
        ({"attr": {"in_force": {"eq": "perhaps"}}}, "unfirable_rule"),
        ({"any_of": [{"attr": {"status": {"eq": "open"}}}, {"attr": {"status": {"eq": "closed"}}}]}, "tautological_rule"),
        ({"attr": {"status": {"eq": "open"}}}, None),
        ({"inbound": {"edge": "supersedes", "min": 2}}, None),
    ],
)
def test_single_rules(when, rule):
    found = {r for r, i in names({"status_values": ["open", "closed"], "edges": EDGES, "rules": [{"name": "r", "when": when}, {"name": "s", "when": {"attr": {"status": {"contains": "open"}}}}]}) if i == "r"}
    assert found == ({rule} if rule else set())


def test_kinds_narrow():
    kinds = {"a": {"id": "a-.*", "status_values": ["x"]}, "b": {"id": "b-.*", "status_values": ["y"]}}
    edges = [{"name": "e", "from": ["a"], "to": ["b"]}, {"name": "f", "from": ["b"], "to": ["b"]}]
    raw = {"kinds": kinds, "edges": edges, "rules": [{"name": "both", "when": {"outbound": "e", "inbound": "f"}}, {"name": "own", "when": {"outbound": "e", "attr": {"status": {"eq": "y"}}}}, {"name": "fine", "when": {"outbound": "e", "attr": {"status": {"eq": "x"}}}}]}
    assert names(raw) == {("unfirable_rule", "both"), ("unfirable_rule", "own"), ("unused_status", "b")}


def test_expansion():
    c = Condition.read({"not": {"any_of": [{"inbound": "e"}, {"attr": {"a": {"eq": "x"}}, "outbound": "e"}]}})
    got = {frozenset(map(str, a)) for a in lint.expand(c).alternatives}
    assert got == {frozenset({"inbound e 0 to 0", "a not x"}), frozenset({"inbound e 0 to 0", "outbound e 0 to 0"})}
    deep = {"attr": {"a": {"eq": "x"}}}
    for _ in range(20):
        deep = {"not": deep}
    assert not lint.expand(Condition.read(deep)).whole


def test_presets_are_clean():
    assert [lint.lint(c) for c in presets().values()] == [[], []]


def test_locator():
    text = "preset: adr\nrules:\n- name: one\n  when: {inbound: supersedes}\n- severity: warn\n  name: two\nkinds:\n  clause: {}\n"
    at = lint.locator(text)
    assert at["rules", "one"] == 3 and at["rules", "two"] == 5 and at["kinds", "clause"] == 8 and at["preset", ""] == 1
    rows = lint.located([lint.LintFinding("warn", "r", "two", "d", "f", "rules")], "c.yaml", at)
    assert rows == [("warn", "r", "two", "d", "c.yaml", 5, [], False, "f")]


def test_samples():
    for pattern in [k.id for _, k in presets()["spec"].kinds if k.id] + [r"(?:ab|cd)+\d{2}", r"x-[^/]?y"]:
        texts = {fixtures.sample(pattern, i) for i in range(1, 5)} if pattern[0] == "^" else {fixtures.sample(pattern, 0)}
        assert all(re.fullmatch(pattern, t) for t in texts) and (len(texts) == 4 or pattern[0] != "^")


def test_generated_documents():
    """Texts alone: the silent side leaves out or turns one fact; a neighbour that must not be a MUST is another word."""
    made = fixtures.generate(presets()["spec"], "interop_not_must", "2026-01-01")
    texts = [t for _, _, t in made["ruleid"]]
    assert sum("interop: [" in t for t in texts) == 1 and any("modality: MAY" in t for t in texts)
    drift = fixtures.generate(presets()["adr"], "status_drift", "2026-01-01")
    assert [len(drift[s]) for s in ("ruleid", "ok")] == [2, 2] or [len(drift[s]) for s in ("ruleid", "ok")] == [2, 1]
    odd = fixtures.generate(presets()["spec"], "premature_superseded", "2026-01-01")
    assert "status: superseded" in odd["ruleid"][0][2] and "status: superseded" not in odd["ok"][0][2]


def test_missing_fixtures():
    cfg = read({"rules": [{"name": "mine", "when": {"inbound": "supersedes"}}]})
    found, _ = lint_corpus.check_fixtures({}, cfg)
    assert [(f.rule, f.id) for f in found] == [("missing_fixture", "mine")] * 2
