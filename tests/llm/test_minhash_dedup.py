import random
import re
from collections import Counter
from itertools import combinations

import pytest

from tracewright.llm import minhash_dedup
from tracewright.llm.shingles import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_sets(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    sets = [word_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, j in {p for own in by.values() for p in combinations(own, 2)}:
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t", "One", "one", "a b c", "A B  C", "a b c d e", "a b c d e f", "X\x0bY", "x y"]
    line = prose(12)
    for _ in range(60):
        texts.append(" ".join(prose(rng.randint(5, 60)) + line))
    for size in (6, 20, 60, 150, 400, 2500):
        base = prose(size)
        for i in range(90 if size == 150 else 8):
            texts.append(" ".join(edited(rng, base, rng.randint(0, max(1, size // 25)))))
        chain = base
        for i in range(6):  # each is like the one before, not like the first
            chain = chain[size // 16 :] + prose(size // 16)
            texts.append(" ".join(chain))
    texts += [texts[30]] * 40 + [" ".join(line)] * 3 + [" ".join(line * 30)] * 2
    rng.shuffle(texts)
    return [*enumerate(texts, 100), (None, texts[5]), (None, "alone and null id"), (101, texts[9]), (101, "same id other text")]


@pytest.mark.parametrize("short", [2, 32])
def test_against_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(minhash_dedup, "SHORT", short)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sketch string, n int")
    got = minhash_dedup.groups(df).collect()
    want = brute(rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_tables_of_the_driver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.groups(docs).collect()}
    assert got == {d: (n, c) for d, n, c in brute(rows)}


def test_nothing(spark):
    schema = "doc_id long, text string"
    assert minhash_dedup.groups(spark.createDataFrame([], schema)).collect() == []
    rows = minhash_dedup.groups(spark.createDataFrame([(1, None), (2, ""), (3, "a b")], schema)).orderBy("doc_id").collect()
    assert [(r.component_id, r.kept) for r in rows] == [(1, True), (2, True), (3, True)]


def test_shingle_counts():
    for _, text in corpus()[:200]:
        assert len(shingles(text)) == len(word_sets(text))


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    out = {r.nid: r.label for r in minhash_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}


def test_partner_beyond_the_sketch(spark):
    """48 shingles within 56, of which the 8 largest hashes, all common, are not retained."""
    i = 0
    while True:
        words = [f"p{i}q{j}" for j in range(60)]
        small, large = " ".join(words[:52]), " ".join(words)
        if set(sorted(shingles(large))[-8:]) <= set(shingles(small)):
            break
        i += 1
    assert (len(shingles(small)), len(shingles(large))) == (48, 56)
    rows = [(1, small), (2, large), (3, "quite another text")]
    got = minhash_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows) == [(1, 48, 1), (2, 56, 1), (3, 1, 3)]


def test_one_of_each(spark):
    rows = [(r[0], r[1], i % 3) for i, r in enumerate(corpus())] + [(100, corpus()[0][1], 0), (None, "alone and null id", 7)]
    kept = minhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, own_mark int")).collect()
    members = {}
    for (d, t, _), (_, n, c) in zip(rows, brute([(i, r[1]) for i, r in enumerate(rows)]), strict=True):
        if n:
            members.setdefault(c, []).append((d is None, d or 0))
    want = Counter(None if none else d for none, d in map(min, members.values()))
    assert Counter(r.doc_id for r in kept if word_sets(r.text)) == want
    assert sum(not word_sets(r.text) for r in kept) == sum(not word_sets(t) for _, t, _ in rows)


def test_the_estimate_decides(spark, monkeypatch):
    """Without the union sketches' say, unlike pairs reach the comparison of whole sets; with an impossible one, no larger sets link."""
    rows = [r for r in corpus() if len(word_sets(r[1])) > minhash_dedup.KEPT]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r.doc_id for r in minhash_dedup.groups(df).collect() if r.doc_id != r.component_id}
    assert linked
    monkeypatch.setattr(minhash_dedup, "least_shared", lambda percent: minhash_dedup.KEPT + 1)
    alone = minhash_dedup.groups(df).collect()
    assert sum(r.doc_id != r.component_id for r in alone) < len(linked)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "MOST_BITS", 64)
    rows = corpus(seed=8)
    got = minhash_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
