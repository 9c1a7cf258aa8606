"""What the operators share: the shared folder, worker settings and hygiene of inputs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
#: Used only where the session names no shared folder and runs on one machine, as in local tests.
LOCAL_SHARED = "file:///tmp/checkpoints"
#: A key with more than this share of the rows is hot. At most 1 / HOT_SHARE keys can be, which bounds their broadcast.
HOT_SHARE = 0.001


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small, whatever the length of texts."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (ROOT, env.get("PYTHONPATH"))))
        # a worker that one stage has used gives memory back before the next
        env |= {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = LOCAL_SHARED
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back.

    The files live on the shared store, so a lost executor costs no recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder that materialize() wrote df to; only for rounds whose successor is written."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame) -> DataFrame:
    """rows, left-joined with a table that has one row for each key.

    hot is the part of the table whose keys are hot, 1 / HOT_SHARE rows at most: it is broadcast. Rows of hot
    keys, and of null ones, which find nothing, are dealt by a hash of themselves, so no task gets a hot group.
    """
    columns = [c for c in table.columns if c != key]
    small = hot.select(F.col(key).alias("hot_key_"), F.struct(*columns).alias("hot_"))
    every = table.select(F.col(key).alias("key_"), F.xxhash64(key).alias("key_hash_"), F.struct(*columns).alias("found_"))
    asks = F.col("hot_key_").isNull() & F.col(key).isNotNull()
    wide = rows.join(F.broadcast(small), F.col(key) == F.col("hot_key_"), "left").withColumn("ask_", F.when(asks, F.col(key)))
    wide = wide.withColumn("deal_", F.when(asks, F.xxhash64(key)).otherwise(F.xxhash64(*rows.columns)))
    out = wide.join(every.hint("merge"), (F.col("ask_") == F.col("key_")) & (F.col("deal_") == F.col("key_hash_")), "left")
    return out.select(*rows.columns, *(F.coalesce(F.col("hot_")[c], F.col("found_")[c]).alias(c) for c in columns))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts as empty ones; other columns cannot clash after this."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n (null ids fall in no fold: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of an id filter at least and at most (8 and 256 MB), bits for each id between these, and bits of one of its shards.
LEAST_BITS, MOST_BITS, BITS_PER_ID, SHARD_BITS = 1 << 26, 1 << 31, 32, 1 << 16


def id_filter(ids: DataFrame) -> Column:
    """A condition on doc_id that holds for all ids(id long), and for few others.

    It is a bitmap over hashes, made in shards; rows that can't match are left where they lie instead of being
    shuffled to a join, which must still follow. Its size follows the number of ids up to MOST_BITS; with far
    more ids than that it lets more rows through, and the join does the work.
    """
    size = LEAST_BITS
    n = ids.count()
    while size < min(n * BITS_PER_ID, MOST_BITS):
        size *= 2
    place = F.pmod(F.xxhash64("id", F.lit(41)), F.lit(size))
    bits = ids.select(place.alias("bit")).distinct().select(F.floor(F.col("bit") / SHARD_BITS).cast("int").alias("shard"), F.pmod("bit", F.lit(SHARD_BITS)).cast("int").alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for places in b["bits"]:
                m = np.zeros(SHARD_BITS, bool)
                m[places.values.to_numpy(zero_copy_only=False)] = True
                maps.append(np.packbits(m).tobytes())
            yield pa.record_batch([b["shard"], pa.array(maps, pa.binary())], ["shard", "map"])

    # SHARD_BITS places at most in a list, MOST_BITS / 8 bytes at most in all
    shards = bits.groupBy("shard").agg(F.collect_list("bit").alias("bits")).mapInArrow(run, "shard int, map binary")
    whole = np.zeros(size // 8, np.uint8)
    for r in shards.toLocalIterator():
        at = r["shard"] * SHARD_BITS // 8
        whole[at : at + SHARD_BITS // 8] = np.frombuffer(r["map"], np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf(T.BooleanType())
    def held(bit: pd.Series) -> pd.Series:
        k = bit.to_numpy(np.int64, na_value=0)
        return pd.Series((sent.value[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool))

    return held(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(size)))
