"""Tables between the rounds of iterative operators, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; one machine alone may go without the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage through a Parquet table below spark.checkpoint.dir."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order of some columns, by range partitions: no task and no driver gets them all."""
    cut = written(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return cut.join(F.broadcast(before), "part_").filter(F.col("before_") < n).withColumn("rank_", F.col("before_") + rank).filter(F.col("rank_") <= n).select(df.columns)


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """T5: df with `position` from 1 in the order of an md5 of the key and a seed; by range partitions, as first_rows()."""
    hashed = df.withColumn("key_", F.md5(F.concat_ws("#", *key, F.lit(seed))))
    cut = written(hashed.repartitionByRange("key_", *key).withColumn("part_", F.spark_partition_id()), "shuffled")
    sizes = cut.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part_").orderBy("key_", *key))
    return cut.join(F.broadcast(before), "part_").select(*df.columns, (F.col("before_") + rank).alias("position"))


#: Rows of each side in a cell of product().
CELL = (1024, 4096)


def product(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left.join(right, key) for groups whose pairs outnumber their rows by far.

    A group is cut into cells of about CELL rows a side, which are dealt out evenly: no task gets all pairs of a large
    group, and what is copied for the cells is a hundredth of the pairs or less, besides each row once.
    """
    spark = left.sparkSession
    a, b = written(left, "left"), written(right, "right")
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    sizes = written(count(a, "l_").join(count(b, "r_"), key), "sizes")
    total = sizes.agg(F.coalesce(F.sum(F.col("l_") * F.col("r_")), F.lit(0))).first()[0]
    cuts = sizes.select(key, F.ceil(F.col("l_") / CELL[0]).alias("cl_"), F.ceil(F.col("r_") / CELL[1]).alias("cr_")).filter("cl_ > 1 OR cr_ > 1")
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (CELL[0] * CELL[1] // 2))), 1 << 15)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        cut = df.join(cuts, key, "left")
        plain = [c for c, kind in df.dtypes if "map<" not in kind]  # maps have no hash
        mine = F.pmod(F.xxhash64(*plain), F.coalesce(own, F.lit(1)))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
        return cut.select(*df.columns, mine.alias(own), each.alias(other)).repartition(parts, key, "cl_", "cr_")

    return dealt(a, "cl_", "cr_").join(dealt(b, "cr_", "cl_"), [key, "cl_", "cr_"]).drop("cl_", "cr_")
