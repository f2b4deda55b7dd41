import hashlib
import random

from tracewright.llm import entries
from tracewright.llm.fingerprints import Fingerprinted, PrefixHashes, fingerprint, fingerprints


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(text), fingerprint(edited), fingerprint(after)))
    return out


def test_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "a", "ab", "abc", "é漢👍" * 30, "x" * 5000] + ["".join(rng.choice("abcdé 漢") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    ids = rng.sample(range(-50, 10**12), len(texts))
    rows = [*zip(ids, texts, strict=True), (None, "n2"), (None, "n1"), (ids[20], "again"), (ids[21], texts[21])]
    spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entries.op3_fingerprints(spark, str(tmp_path)).collect()
    want = brute(rows)
    key = lambda r: tuple((x is not None, x) for x in r[:5])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted((r[:5] for r in want), key=key)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    equal = [r for r in got if r.fingerprint == r.edited_fingerprint]
    assert equal and all(r.near_edited == 1 for r in equal)


def test_one_row_and_none(spark, tmp_path):
    spark.createDataFrame([(1, "abcdef")], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    row = entries.op3_fingerprints(spark, f"{tmp_path}/a").first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert entries.op3_fingerprints(spark, f"{tmp_path}/b").collect() == []


def test_spans_and_extensions():
    rng = random.Random(6)
    a, b = ("".join(rng.choice("ab") for _ in range(300)) for _ in range(2))
    b = b[:100] + a[50:150] + b[200:]
    x, y = PrefixHashes(a), PrefixHashes(b)
    for _ in range(300):
        i, j, n = rng.randrange(200), rng.randrange(200), rng.randrange(12)
        assert x.equal(i, j, n, y) == (a[i : i + n] == b[j : j + n])
        size = 0
        while i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size]:
            size += 1
        assert x.extension(i, j, y) == size
    assert x.extension(50, 100, y) >= 100


def test_likeness_orders():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(40)]
    rows = [Fingerprinted(i, t).row(Fingerprinted(i + 1, texts[(i + 1) % 40])) for i, t in enumerate(texts)]
    assert min(r[5] for r in rows) > 0.2 and max(r[6] for r in rows) < 0.05


def test_column(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "doc_id long, text string")
    out = [r.fingerprint for r in fingerprints(df).orderBy("doc_id").collect()]
    assert out[0] == out[2] == fingerprint("a b") and out[1] == fingerprint("")


def test_likeness_is_what_common_extensions_cover():
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b = prose(400), prose(300)
    x = Fingerprinted(1, a)
    edited = Fingerprinted(2, a[:100] + b)
    assert x.likeness(edited) == edited.likeness(x) == 200 / 800
    assert x.likeness(Fingerprinted(3, b)) == 0
    assert x.likeness(Fingerprinted(4, a)) == 1
    moved = Fingerprinted(5, b[:150] + a[200:] + b[150:])
    assert x.likeness(moved) == 0 or 0 <= x.likeness(moved) - 400 / 900 < 0.02  # by whether both keep a span of it; ends may fit by chance
    assert Fingerprinted(6, "").likeness(Fingerprinted(7, "abc")) == 0


def test_the_edited_text_keeps_its_parts_hashes():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(2))
        x, y = Fingerprinted(1, a), Fingerprinted(2, b)
        stays, taken = len(a) - len(a) // 3, min(len(a) // 3, len(b))
        text = a[:stays] + b[:taken]
        got, want = x.edited(y, stays, taken, text), Fingerprinted(3, text)
        assert got.sketch[0] == want.sketch[0] and (got.sketch[1] == want.sketch[1]).all()
        assert all((s == t).all() for s, t in zip(got.hashes.sums, want.hashes.sums, strict=True))
