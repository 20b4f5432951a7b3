"""A training corpus from documents: language, near-duplicates, secrets, mixture, tokens.

Each stage takes the rows that the one before it kept, applies one operator and acts on its result; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bytebpe, langid, minhash, mixing, secret_scan
from lattica.llm.common import staged, table, text_column
from lattica.llm.queries import bpe, domains
from lattica.plans.cut import mark, release

#: Shares of the corpus's tokens by domain (good, poor, toxic), of as many tokens as keep good text at the rate WHOLE.
TARGETS, WHOLE = (0.86, 0.12, 0.02), 1.05


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name of theirs can clash with an operator's."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("__any")).alias("__rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs again, some replaced."""
    kinds = dict(docs.dtypes)
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"__rest.{c}") for c in docs.columns} | {c: x for c, x in new.items() if c in kinds}
    return rows.select(*[x.cast(kinds[c]).alias(c) for c, x in own.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without text or without a letter go. The language found is written to lang."""
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.predict(_packed(docs), model, keep=("text", "__rest"))
    return _unpacked(found.where(F.col("lang_pred") != langid.UNKNOWN), docs, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts: that of the smallest id, null ones last. Rows without a word stay.

    Rows that share an id are told apart by their texts. Repeated rows of one id and text are aggregated, not sorted.
    """
    found = staged(minhash.text_classes(docs).select("id", "key", "n_words", "best"))
    pair = [F.col("id").alias("__id"), F.col("key").alias("__key2")]
    whole = staged(found.where("id IS NOT NULL").groupBy(F.col("id").alias("__id")).agg(F.bool_or("best").alias("some")).where("NOT some").select("__id"))
    mixed = staged(found.where("NOT best").select(*pair).distinct().join(whole, "__id", "left_anti"))
    again = staged(found.where("best AND n_words > 0").groupBy(*pair).count().where("count > 1").drop("count"))
    rows = _packed(docs).withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), text_column("text")))
    own = F.col("doc_id").cast("long")
    same = (F.col("__key") == F.col("__key2")) & own.eqNullSafe(F.col("__id"))
    kept = rows.join(whole, own == F.col("__id"), "left_anti")
    if mixed.take(1):
        kept = kept.join(mixed, same, "left_anti")
    if not again.take(1):
        return _unpacked(kept, docs)
    once = kept.join(again, same, "left_semi").groupBy("doc_id", "__key").agg(F.first(F.struct("text", "__rest")).alias("__row"))
    once = once.select("doc_id", "__row.text", "__row.__rest")
    return _unpacked(kept.join(again, same, "left_anti").select(once.columns).unionByName(once), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret and linked part of a credential masked, and n_chars of those counted anew."""
    found = secret_scan.find_secrets(_packed(docs), keep=["text", "__rest"])
    found = secret_scan.with_redacted(found.select("doc_id", F.col("text").alias("__text"), "found", "__rest"), "__text", "found", "text")
    found = found.select("doc_id", "text", "__rest", (F.size("found") > 0).alias("__hit"))
    new = {"n_chars": F.when(F.col("__hit"), F.length("text")).otherwise(F.col("__rest.n_chars"))} if "n_chars" in docs.columns else {}
    return _unpacked(found, docs, **new)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rate says, so that the domains' tokens meet TARGETS; good ones stay whole."""
    labels = domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix_to_targets(_packed(docs), labels, TARGETS, bpe(), whole=WHOLE, keep=("text", "__rest"))
    return _unpacked(mixed.where("copies > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return bytebpe.encode_and_decode(docs, *bpe()).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_domains),
    ("byte_bpe", encode),
]

#: Learned models decide in two stages, so SQL can't express the rows. A test works out which rows come out, and their
#: texts; each stage's operator has its own test against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before = mark()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
            release(spark, before, keep=docs)  # what the stage needed on its way
    return docs
