import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import repeat_removal


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), len(repeat_removal.runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(length, seed=1):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefgh é漢\n") for _ in range(n))
    passage, line = prose(2 * length), prose(length // 3)
    texts = [None, "", "a", "a" * (length - 1), "b" * length, "a" * (2 * length), "ab" * length, prose(length), prose(length) * 2, passage]
    for _ in range(60):
        cut = rng.randint(0, len(passage) // 2)
        texts.append(prose(rng.randint(0, 2 * length)) + passage[cut : cut + rng.randint(length // 2, len(passage))] + line + prose(rng.randint(0, length)))
    texts += [prose(3 * length) + line for _ in range(30)]
    base = prose(3 * length)
    for _ in range(10):
        i = rng.randrange(len(base))
        texts.append(base[:i] + prose(3) + base[i:])
    texts += [texts[20]] * 5 + ["short copies"] * 3
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("length", "large"), [(60, 2048), (60, 3), (17, 8), (400, 2048), (400, 8)])
def test_against_brute_force(spark, monkeypatch, length, large):
    monkeypatch.setattr(repeat_removal, "LARGE", large)
    texts = corpus(length)
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (3, texts[40], "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string, nid int")
    got = repeat_removal.removals(df, length).collect()
    want = brute([r[1] for r in rows], length)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)


def test_chunks_do_not_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(repeat_removal, "CHUNK", 7)
    texts = corpus(60, seed=5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, repeat_removal.removals(df, 60).collect()))
    assert got == [(i, *w) for i, w in enumerate(brute(texts, 60))]


def test_cleaned(spark):
    texts = corpus(60)
    df = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "doc_id long, text string, spans long")
    out = {r.doc_id: r for r in repeat_removal.cleaned(df, 60).collect()}
    assert len(out) == len(texts)
    for i, (t, w) in enumerate(zip(texts, brute(texts, 60), strict=True)):
        assert out[i].spans == i * 2
        if w[1] == 0:
            assert out[i].text == t
        else:
            assert len(out[i].text.encode()) <= w[0] - w[1]


def test_nothing(spark):
    schema = "doc_id long, text string"
    assert repeat_removal.removals(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r)[:4] for r in repeat_removal.removals(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 0, 0)]


@pytest.mark.parametrize("length", [1, 3, 20])
def test_backward_extension(length):
    rng = random.Random(length)
    for _ in range(30):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 120)))
        counts = Counter(data[i : i + length] for i in range(len(data) - length + 1))
        want = [i for i in range(len(data) - length + 1) if counts[data[i : i + length]] > 1]
        assert repeat_removal.bwt_repeats(data, length).tolist() == want


def test_short_runs_can_stay(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    texts = [f"one1 {passage} two", f"three2 {passage} four", "x " + "=" * 150 + " y", "z " + "=" * 150 + " w"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, cut_h1 string")
    out = {r.doc_id: r.text for r in repeat_removal.cleaned(df, 60, least_words=20).collect()}
    assert out == {0: "one1two", 1: "three2four", 2: texts[2], 3: texts[3]}


def test_transform_of_several_parts():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([1, 3, 8, 20])
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            parts += [parts[0], parts[-1][3:]]
        counts = Counter(d[i : i + length] for d in parts for i in range(len(d) - length + 1))
        want = [[i for i in range(len(d) - length + 1) if counts[d[i : i + length]] > 1] for d in parts]
        assert [x.tolist() for x in repeat_removal.transform_repeats(parts, length)] == want
