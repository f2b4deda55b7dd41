"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import fingerprints, language_id, license_scan, minhash_dedup, mixing, repeat_removal, sentencepiece_codec, token_counts, topk_search, url_filter
from tracewright.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096
WEIGHTS = (5, 2, 1)


def coded_digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of rows with ids and decoded text."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return coded_digests(sentencepiece_codec.coded(docs, PIECE_MODEL))


URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills") for top in ("com", "net", "org")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS).drop("listed")


OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN '.' || host LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN '.' || host LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN '.' || host LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN {" OR ".join(f"'.' || host LIKE '%.{h}'" for h in BLOCKED_HOSTS)} THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_by_next(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.trained(docs)
    return language_id.predict(docs.select("doc_id", "text"), net).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.groups(table(spark, sf_dir, "documents"))


def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.removals(table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP7_SQL = """
WITH valid AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).drop("expressions")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, PIECE_MODEL).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_filter": op2_url_filter,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_repeat_removal": op6_repeat_removal,
    "op7_topk_search": op7_topk_search,
    "op8_mixing": op8_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": OP2_SQL,
    "op7_topk_search": OP7_SQL,
}
