"""The thin queries over the driver tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, content_store, decontaminate, exact_dedup, language_id, line_crf, near_dedup, secret_scan, separator_scan, toxicity
from .common import documents, fold, prepare


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.dedup(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return byte_bpe.digests(documents(spark, sf_dir))


def op7_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return content_store.facts(content_store.write(documents(spark, sf_dir)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return separator_scan.count_documents(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    model = language_id.train(docs, F.coalesce(fold(4) != 2, F.lit(False)))
    out = language_id.predict(docs, model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.learn(docs)))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.dedup(documents(spark, sf_dir), size=4, percent=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.coalesce(fold(5) != 0, F.lit(False)))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_crf.train(docs, labels, F.coalesce(fold(3) != 1, F.lit(False)))
    out = line_crf.score(docs, model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_crf": op2_line_crf,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op10_language_id": op10_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_content_store": op7_content_store,
    "op9_byte_bpe": op9_byte_bpe,
    "op8_exact_dedup": op8_exact_dedup,
}

QUERY_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
