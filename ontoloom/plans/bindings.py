"""The driver tables read as concepts, labels, hierarchies, alignments and vectors, in Spark and in DuckDB SQL.

Sources are suppliers (S), targets customers (C); above them are nations (N), regions (R), market segments (M)
and one root, so customers have two parents. Suppliers and customers of one key are aligned, fully if their
nations share a region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, col: str) -> Column:
    return F.concat(F.lit(letter), F.col(col).cast("string"))


def source(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").join(n, "s_nationkey").select(_id("S", "s_suppkey").alias("concept"), F.array("s_name", "n_name").alias("labels"))


def target(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(n, "c_nationkey").select(_id("C", "c_custkey").alias("concept"), F.array("c_name", "n_name").alias("labels"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name, c, p: table(spark, sf, name).select(c.alias("child"), p.alias("parent"))
    root = F.lit("ROOT")
    return (
        t("nation", _id("N", "n_nationkey"), _id("R", "n_regionkey"))
        .unionByName(t("region", _id("R", "r_regionkey"), root))
        .unionByName(t("supplier", _id("S", "s_suppkey"), _id("N", "s_nationkey")))
        .unionByName(t("customer", _id("C", "c_custkey"), _id("N", "c_nationkey")))
        .unionByName(t("customer", _id("M", "c_mktsegment"), root).distinct())
        .unionByName(t("customer", _id("C", "c_custkey"), _id("M", "c_mktsegment")))
    )


def reference(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("rs")), "s_nationkey")
    c = table(spark, sf, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("rc")), "c_nationkey")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select(_id("S", "s_suppkey").alias("SrcEntity"), _id("C", "c_custkey").alias("TgtEntity"), F.when(F.col("rs") == F.col("rc"), 1.0).otherwise(0.5).alias("Score"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.explode(F.array(_id("S", "vec_id"), _id("C", "vec_id"))).alias("concept"), "embedding")


def texts(spark: SparkSession, sf: str, name: str, key: str, letter: str) -> DataFrame:
    return table(spark, sf, name).select(_id(letter, key).alias("concept"), F.array("text").alias("labels"))


SOURCE_SQL = "source AS (SELECT 'S' || s_suppkey AS concept, s_name || ' ' || n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
TARGET_SQL = "target AS (SELECT 'C' || c_custkey AS concept, c_name || ' ' || n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey)"
EDGES_SQL = """edges AS (SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation
 UNION SELECT 'R' || r_regionkey, 'ROOT' FROM region
 UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
 UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
 UNION SELECT 'M' || c_mktsegment, 'ROOT' FROM customer
 UNION SELECT 'C' || c_custkey, 'M' || c_mktsegment FROM customer)"""
REFERENCE_SQL = """ref AS (SELECT 'S' || s_suppkey AS src, 'C' || c_custkey AS tgt, CASE WHEN a.n_regionkey = b.n_regionkey THEN 1.0 ELSE 0.5 END AS score
 FROM supplier JOIN customer ON s_suppkey = c_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey),
 pos AS (SELECT DISTINCT src, tgt FROM ref WHERE score = 1)"""
VECTORS_SQL = "vec AS (SELECT p || vec_id AS concept, embedding::DOUBLE[] AS embedding FROM embeddings, (VALUES ('S'), ('C')) AS v(p))"
CLOSURE_SQL = "up AS (SELECT child AS node, parent AS anc, 1 AS hops FROM edges UNION SELECT node, parent, hops + 1 FROM up JOIN edges ON anc = child), closure AS (SELECT node, anc, min(hops) AS hops FROM up GROUP BY 1, 2)"
DEPTH_SQL = """level AS (SELECT DISTINCT parent AS node, 0 AS d FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION SELECT child, d + 1 FROM level JOIN edges ON parent = node),
 depth AS (SELECT node, max(d) AS depth FROM level GROUP BY 1)"""


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def cosine_sql(a: str, b: str) -> str:
    return f"coalesce(list_cosine_similarity({a}, {b}), 0)"


def partial_sql(pairs: str) -> str:
    """CTEs over pairs(l1, l2), the last one `partial`(l1, l2, ratio).

    The longest common subsequence with each window is counted in bits: one for each character of the shorter text.
    """
    return f"""pl AS (SELECT DISTINCT l1, l2 FROM {pairs}),
 po AS (SELECT l1, l2, CASE WHEN length(l1) <= length(l2) THEN l1 ELSE l2 END AS s, CASE WHEN length(l1) <= length(l2) THEN l2 ELSE l1 END AS l FROM pl UNION ALL SELECT l1, l2, l2, l1 FROM pl WHERE length(l1) = length(l2)),
 pm AS (SELECT l1, l2, length(s) AS n, length(l) AS m, list_transform(range(1, length(l) + 1), lambda i: coalesce(list_sum(list_transform(list_filter(range(0, length(s)), lambda j: s[j + 1] = l[i]), lambda j: 1::BIGINT << j)), 0)::BIGINT) AS k FROM po WHERE s <> ''),
 pw AS (SELECT l1, l2, n, unnest(range(1 - n, m)) AS first, k FROM pm), px AS (SELECT l1, l2, n, list_slice(k, greatest(first, 0) + 1, first + n) AS x FROM pw),
 pz AS (SELECT l1, l2, n, len(x) AS c, list_reduce(list_prepend((1::BIGINT << n) - 1, x), lambda v, y: ((v + (v & y)) | (v - (v & y))) & ((1::BIGINT << n) - 1)) AS v FROM px),
 partial AS (SELECT l1, l2, max(200.0::DOUBLE * (n - bit_count(v)) / (n + c)) AS ratio FROM pz GROUP BY 1, 2 UNION ALL SELECT l1, l2, CASE WHEN l1 = l2 THEN 100.0 ELSE 0.0 END FROM pl WHERE l1 = '' OR l2 = '')"""
