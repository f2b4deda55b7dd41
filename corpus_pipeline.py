"""A corpus pipeline of the llm operators: each stage works on what the one before kept.

language_id       rejects documents in which no language is recognised: without a letter,
                  or with a score hardly above that of a guess
minhash_dedup     keeps one document of each near-duplicate group, the one of smallest id
repeat_removal    leaves out of all texts the passages of over 50 words that occur more than once
mixing            repeats or leaves out documents until sources have their target shares
sentencepiece     encodes and decodes what is left; its rows are the pipeline's result

All but the last return the columns of documents; n_chars follows the text.  SQL can't
express the stages, so ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language_id, minhash_dedup, mixing, repeat_removal, sentencepiece_codec
from tracewright.llm.common import materialize
from tracewright.llm.entries import PIECE_MODEL, WEIGHTS, coded_digests

#: How far the score must be from that of a guess among the languages learned (0) to certainty (1).
LEAST_LEAD = 0.05
#: A repeated passage has so many words, and so many bytes: of the runs of over 50 words that
#: two different documents of the test tables share, 97 of 100 have 200 bytes or more.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 200
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts go, as do texts without a letter; repeated rows are judged alike.  An empty table stays empty."""
    net = language_id.trained(docs)
    found = language_id.predict(docs.select(*COLUMNS), net)
    guess = 1 / max(1, len(net.labels))
    certain = F.col("score") >= guess + LEAST_LEAD * (1 - guess)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & certain).select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 85 of 100 shingles of five words; rows of one id are told apart by their texts."""
    return minhash_dedup.one_of_each(docs.select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated passage goes; what is left of null or short texts stays as it is.

    Repeated rows are whole passages of each other and lose their text where it has so many words.
    """
    cleaned = repeat_removal.cleaned(docs.select(*COLUMNS), PASSAGE_BYTES, PASSAGE_WORDS)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null texts and those without words go, they weigh nothing."""
    return mixing.taken(docs.select(*COLUMNS), WEIGHTS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of op1 for each row; null text counts as empty, repeated rows come out as often as they stand."""
    return coded_digests(sentencepiece_codec.coded(docs.select("doc_id", "text"), PIECE_MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_recognised),
    ("minhash_dedup", keep_one_of_group),
    ("repeat_removal", remove_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
