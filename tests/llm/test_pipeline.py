import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_minhash_dedup import brute as groups
from tracewright.llm import mixing
from tracewright.llm.common import materialize
from tracewright.llm.repeat_removal import runs

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def without_passages(texts):
    """Texts without maximal runs of 51 words and more that 200-byte strings standing twice cover."""
    size = corpus_pipeline.PASSAGE_BYTES
    data = [t.encode() for t in texts]
    counts = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - size + 1):
            if counts[d[i : i + size]] > 1:
                gone[i : i + size] = True
        for first, last in runs(gone):
            if len(d[first : last + 1].split()) < corpus_pipeline.PASSAGE_WORDS:
                gone[first : last + 1] = False
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def stages(spark, docs, sf_dir):
    tables = [docs]
    for _, f in corpus_pipeline.STAGES:
        tables.append(materialize(f(spark, tables[-1], sf_dir)))
    return tables


def check(tables, low=0.97):
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    for t in tables[:-1]:
        assert t.columns == corpus_pipeline.COLUMNS
    with_letters = [r for r in rows[0] if r["text"] and any(c.isalpha() for c in r["text"])]
    assert len(rows[1]) >= low * len(with_letters)
    assert all(any(c.isalpha() for c in r["text"]) for r in rows[1])
    judged = groups([(r["doc_id"], r["text"]) for r in rows[1]])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(d for d, _, c in judged if d == c)
    cut = {r["doc_id"]: t for r, t in zip(rows[2], without_passages([r["text"] for r in rows[2]]), strict=True)}
    assert {r["doc_id"]: r["text"] for r in rows[3]} == cut and len(rows[3]) == len(rows[2])
    assert all(r["n_chars"] == len(r["text"]) for r in rows[3])
    copies = Counter(r["doc_id"] for r in rows[4])
    mixed = {r.doc_id: r.copies for r in mixing.mix(tables[3]).collect() if r["size"]}
    assert copies == Counter({d: c for d, c in mixed.items() if c})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows[4]:
        ids = LIBRARY.encode(r["text"])
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(tuple(r.values()) for r in rows[5]) == sorted(want)


def test_stage_by_stage(spark):
    sf_dir = "/root/testdata/sf0.001"
    check(stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))


def test_run(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert a and a == b


def test_odd_rows(spark, tmp_path):
    text = "the of and to in " * 60
    data = [(i, f"{text} more words number {i}", "en", "a", 5) for i in range(10, 30)]
    data += [(1, None, "en", "a", 0), (2, "", None, None, None), (None, text, "en", None, 5), (None, "der die das und in den", "de", "b", 5), (4, text, "en", "a", 5), (4, text, "en", "a", 5), (4, "other words of that id", "en", "a", 5), (5, "123", "en", "a", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()}
    assert kept and not kept & {1, 2, 5}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
