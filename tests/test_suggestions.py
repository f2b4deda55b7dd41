import re

from tracewright.operators import checks
from tracewright.operators.corpus import EDGE, NODE, Corpus
from tracewright.plans.config import Config


def test_nearest_of_all_ids(spark):
    known = [f"{n:04}" for n in (1, 2, 3, 50, 99, 100, 700)] + ["A-100", "B-100", "C-100", "D-100", "E-100"]
    asked = [("0001", "9001"), ("0700", "0699"), ("0002", "0100x"), ("0003", "0000"), ("0099", "0400"), ("0050", "none")]
    nodes = [(i, "k", f"{i}.md", i, "accepted", None, 1, {}, {}, {}) for i in known]
    edges = [(a, b, "supersedes", "structured", {}) for a, b in asked]
    c = Corpus(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), Config(), "2026-01-01")
    got = {r.id: r.fix for r in checks.suggestions(c, checks.dangling_ref(c)).collect()}
    number = lambda s: int(re.search("[0-9]+", s)[0])
    want = {a: ", ".join(sorted((i for i in known if i != a), key=lambda i: (abs(number(i) - number(b)), i))[:3]) if b != "none" else None for a, b in asked}
    assert got == want and got["0001"] == "0700, 0100, A-100"
