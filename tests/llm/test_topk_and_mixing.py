import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np

from tracewright.llm import entries, mixing, topk_search


def brute_top(rows, k=20):
    valid = [(i, [int(np.floor(64.0 * np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in valid:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in valid if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(700)]
    rows += [(700 + i, rows[40][1]) for i in range(60)] + [(1000, None), (1020, [1.0, None] + [0.0] * 4), (1040, [float("nan")] + [1.0] * 5), (1060, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (1080, [0.0] * 6), (1100, [2.0]), (1120, [])]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_top(rows)
    assert sorted(map(tuple, entries.op7_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())) == want
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 200)
    monkeypatch.setattr(topk_search, "QUERIES_AT_ONCE", 9)
    monkeypatch.setattr(topk_search, "FIRST_DEPTH", 4)
    assert sorted(map(tuple, entries.op7_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())) == want


def test_top_k_few(spark):
    schema = "vec_id long, embedding array<float>"
    from pyspark.sql import functions as F

    q = F.col("vec_id") % 20 == 0
    assert topk_search.top_k(spark.createDataFrame([], schema), q).collect() == []
    assert topk_search.top_k(spark.createDataFrame([(0, [1.0])], schema), q).collect() == []
    got = topk_search.top_k(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [3.0])], schema), q).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 192), (0, 3, 1, 64 * 128), (0, 4, 1, 64 * 128)]
    big = topk_search.top_k(spark.createDataFrame([(0, [3e6]), (1, [3e6]), (2, [-3e6])], schema), q).orderBy("rank").collect()
    assert [r.score for r in big] == [192000000**2, -(192000000**2)]


def test_top_k_of_repeated_ids(spark, tmp_path, monkeypatch):
    """More than k rows of the best id, two of every other: each row is a candidate, as in the SQL."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(300) for _ in range(2)]
    rows += [(1, [9.0 * (x > 0) - 9.0 * (x < 0) for x in rows[0][1]])] * 30 + [(7, [8.0] * 4)] * 25
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({entries.OP7_SQL})").fetchall())
    for first_depth, block_rows in ((topk_search.FIRST_DEPTH, topk_search.BLOCK_ROWS), (4, 100)):
        monkeypatch.setattr(topk_search, "FIRST_DEPTH", first_depth)
        monkeypatch.setattr(topk_search, "BLOCK_ROWS", block_rows)
        got = entries.op7_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == want


def test_a_bound_from_elsewhere_skips_a_block(monkeypatch):
    rows = np.arange(400.0).reshape(100, 4)
    block = topk_search.Block(np.arange(100), rows)
    monkeypatch.setattr(topk_search, "scores_of", None)  # any search would fail
    scores, _ = block.search(np.array([-1]), np.ones((1, 4)), 5, np.array([10**6]))
    assert (scores == topk_search.LOWEST).all()


def test_bound_stops_early():
    ids = np.arange(20000)
    rows = np.zeros((20000, 4))
    rows[:, 0] = -np.arange(20000)
    met = []
    real = topk_search.scores_of
    topk_search.scores_of = lambda q, r: met.append(len(r)) or real(q, r)
    try:
        scores, found = topk_search.Block(ids, rows).search(np.array([-1]), np.array([[2.0, 0, 0, 0]]), 5)
    finally:
        topk_search.scores_of = real
    assert sorted(found[0]) == [0, 1, 2, 3, 4] and sum(met) < 1000


def brute_targets(sizes, weights=(5, 2, 1)):
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        weight = sum(w[s] for s in order if s not in capped)
        level = Fraction(rest, weight) if weight else Fraction(0)
        more = {s for s in order if s not in capped and level * w[s] > 3 * sizes[s]}
        if not more:
            return {s: float(3 * sizes[s] if s in capped else level * w[s]) for s in order}
        capped |= more


def test_mixing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(2)
    names = [None, "", "é", "z", "Z", "hot", "hot", "hot", "tiny", "👍", "ｚ"]
    data = []
    for i in range(1500):
        source = rng.choice(names) if i else "tiny"
        text = None if i % 97 == 5 else " \t\n".join(["w"] * rng.choice([0, 1, 3, 10, 200 if source != "tiny" else 1]))
        data.append((i, text, source, 0))
    data += [(7, "a b c", "hot", 0)] * 30 + [(None, "a b", "z", 0)] * 2 + [(5000, "x ", "empty words", 0), (5001, "", "nothing", 0)]
    spark.createDataFrame(data, "doc_id long, text string, source string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert len(rows) == len(data)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.copies <= 3
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, s
    key = lambda r: tuple((x is not None, x) for x in r)
    once, again = (sorted(map(tuple, entries.op8_mixing(spark, str(tmp_path)).collect()), key=key) for _ in range(2))
    assert once == again
    shuffled = spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(3)
    assert sorted(map(tuple, mixing.mix(shuffled).selectExpr("doc_id", "size", "source_size", "target", "copies * size").collect()), key=key) == once


def test_mixing_is_unbiased():
    import pyarrow as pa

    sums = np.zeros(6)
    for trial in range(4000):
        rows = [[trial * 10 + i, "s", 5 + i, 45, 30.0, 0, i, 2 / 3 - 0.05 * i, 0, i] for i in range(6)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), mixing.STATE_KINDS, strict=True)], names=mixing.NAMES)
        for out in mixing.meet(iter([batch]), 0, True):
            for r in out.to_pylist():
                sums[r["doc_id"] % 10] += r["copies"]
    assert np.abs(sums / 4000 - (2 / 3 - 0.05 * np.arange(6))).max() < 0.03


def test_mixing_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    rows = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert [(r["size"], r.target, r.copies) for r in rows] == [(0, 0.0, 0)] * 2


def test_taken_rows(spark):
    """Rows come as often as the mix takes them; those that share id, source and text take their copies together."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice("abc"), i % 4) for i in range(300)]
    rows += [(5, "one two three", "a", 1)] * 3 + [(5, "four five", "a", 1), (None, "six seven", None, 2), (None, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int")
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).where("size > 0").collect():
        want[r.doc_id, r.source, r.mark] += r.copies
    out = mixing.taken(docs)
    assert out.columns == docs.columns
    for r in out.withColumn("hash", mixing.mark_of("text")).collect():
        got[r.doc_id, r.source, r.hash] += 1
    assert dict(got) == {k: n for k, n in want.items() if n}
