"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bytebpe, capfilters, langid, licenses, minhash, mixing, quality, resampling, secret_scan, sharding, tokencount, topk, vectorcodes
from lattica.llm.common import table

OLD_SHARDS, SHARDS = 32, 40


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_embeddings(table(spark, sf_dir, "embeddings"), 0.9)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def domains(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("id"), mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


#: Shares of the tokens that op4 mixes to, by domain; the corpus has about 0.77, 0.11 and 0.12, so all three must move.
TARGETS = (0.60, 0.30, 0.10)


def bpe() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_targets(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS, bpe())
    of = lambda c, prefix: [F.element_at(c, i + 1).alias(f"{prefix}_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *of("posterior", "p"), "rate", "copies", *of("misfit", "misfit"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_and_decode(table(spark, sf_dir, "documents"), *bpe()).drop("ids")


def remainder() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder() != 1), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", (remainder() == 1).alias("held_out"), "lang_pred", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(OLD_SHARDS))
    moved, _ = sharding.reshard(docs, old, OLD_SHARDS, SHARDS)
    text = F.coalesce("text", F.lit(""))  # as the new files have it
    return moved.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key", "n_words")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("failed")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_embedding_dedup, op3_token_counts, op4_mixing, op5_license_scan, op6_byte_bpe, op7_language_id, op8_topk, op9_secret_scan, op10_sharding,
        op11_importance_resampling, op12_quality_rules, op13_vector_codes,
    )
}

ORACLE_SQL = {
    "op2_embedding_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL
), ok AS MATERIALIZED (
  SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9
), reach(node, other) AS (
  SELECT a, b FROM pairs UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a
), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
low AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low.low, e.vec_id)) AS component_id,
  least(e.vec_id, coalesce(low.low, e.vec_id)) = e.vec_id AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.node = e.vec_id
""",
    "op5_license_scan": licenses.sql(),
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op9_secret_scan": secret_scan.sql(),
    "op10_sharding": sharding.sql(OLD_SHARDS, SHARDS),
    "op11_importance_resampling": resampling.sql(),
    "op12_quality_rules": quality.sql(),
    "op13_vector_codes": vectorcodes.sql(),
}
