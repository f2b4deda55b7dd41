from tracewright import scratch
from tracewright.operators import checks, corpus as corpora
from tracewright.operators.corpus import EDGE, NODE, Corpus
from tracewright.plans import conditions
from tracewright.plans.config import Condition, Config, read

CFG = {"status_values": ["accepted"], "edges": [{"name": "needs"}, {"name": "cites"}], "projections": [{"name": "wanted", "when": {"inbound": "needs"}}], "binding": "wanted", "rules": [{"name": "two", "severity": "warn", "when": {"outbound": {"edge": "cites", "min": 2}, "attr": {"wanted": {"eq": "true"}}}}]}


def drawn(spark):
    nodes = [(i, "", f"{i}.md", i, "accepted", None, 1, {}, {}, {}) for i in ("0001", "0002", "0003")]
    edges = [("0001", "0002", "needs"), ("0002", "0001", "cites"), ("0002", "0003", "cites"), ("0003", "0009", "cites"), ("0008", "0001", "needs"), ("0007", "0009", "needs")]
    return Corpus(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, "structured", {}) for e in edges], EDGE), read(CFG, Config()), "2026-01-01")


def test_degrees_are_counted_where_a_condition_names_them(spark):
    c = drawn(spark)
    assert not {"deg_in", "deg_out"} & set(c.frame.columns)
    assert {r.id for r in c.binding.collect()} == {"0001", "0002"}
    assert [r.id for r in checks.rules(c).collect()] == ["0002"]
    held = c.holding(met=Condition.read({"not_outbound": "needs", "inbound": {"edge": "cites", "max": 1}}))
    assert {r.id for r in held.where("met").collect()} == {"0002", "0003"}


def test_a_prepared_corpus_is_written_in_three_tables(spark, monkeypatch):
    written = []
    for module in (corpora, conditions):
        monkeypatch.setattr(module, "stored", lambda df: written.append(df) or scratch.stored(df))
    c = drawn(spark).prepared()
    assert len(written) == 3 and c.nodes.columns == drawn(spark).nodes.columns


def test_unknown_ends_are_sought_once(spark):
    c = drawn(spark)
    assert {r.id for r in c.unknown.collect()} == {"0007", "0008", "0009"}
    assert {(r.id, r.detail) for r in checks.dangling_ref(c).collect()} == {("0003", "cites leads to 0009, which is unknown"), ("0001", "needs leads to 0008, which is unknown")}
