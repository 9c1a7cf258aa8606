"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

quality:        documents whose lines the chain field holds for bad are dropped
exact_dedup:    of equal texts the row with the largest doc_id stays
near_dedup:     of a component of near-duplicates (five-word shingles, similarity 0.8) the least doc_id stays
decontaminate:  documents that hold a benchmark item are dropped
byte_bpe:       what is left is encoded, decoded and compared

All stages but the last return the columns of documents. The deduplicating stages decide on rows, not on ids: a
null doc_id comes after all others, of rows that repeat both doc_id and text one stays, and rows that repeat a
doc_id under different texts are documents of their own. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.llm import byte_bpe, common, decontaminate, exact_dedup, line_crf, near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_crf.train(docs, labels, F.coalesce(common.fold(3) != 1, F.lit(False)))
    return line_crf.keep(docs, model)


def _row_key(sha256: Column) -> Column:
    """What tells rows apart: the text's digest and the id, which is left out where it is null."""
    return F.concat_ws("#", sha256, F.col("doc_id").cast("string"))


def _text_sha256() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    kept = exact_dedup.dedup(docs).filter("kept").select(_row_key(F.col("text_sha256")).alias("key_"))
    passed = docs.withColumn("key_", _row_key(_text_sha256())).join(kept, "key_", "left_semi")
    others = F.xxhash64(*(c for c in docs.columns if c not in ("doc_id", "text")))
    first = F.row_number().over(Window.partitionBy("key_").orderBy(others))  # dealt by the join's key already
    return passed.withColumn("row_", first).filter("row_ = 1").select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row_, a number of the row's own, in the order of doc_id with nulls last."""
    order = (F.col("doc_id").asc_nulls_last(), F.col("sha_").asc())
    dealt = docs.withColumn("sha_", _text_sha256()).repartitionByRange(*order).sortWithinPartitions(*order)
    return common.materialize(dealt.drop("sha_").withColumn("row_", F.monotonically_increasing_id()), "numbered")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    columns = docs.columns
    awkward = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    docs = docs.withColumn("row_", F.col("doc_id")) if awkward.isEmpty() else _numbered(docs)
    kept = near_dedup.dedup(docs, size=5, percent=80, id_col="row_").filter("kept").select(F.col("doc_id").alias("row_"))
    return docs.join(kept, "row_", "left_semi").select(columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return byte_bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontaminated),
    ("byte_bpe", encoded),
]

#: The trained stage and the tokenizer can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of the documents that pass all stages."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
QUERY_SQL: dict[str, str] = {}
