"""Graphs that the business tables hold, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUPPLIER_BASE = 10_000_000
WEIGHT = "cast((src * 31 + dst * 17) % 97 + 1 AS double)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who bought from whom: src customer, dst supplier + 10,000,000."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst")).distinct()


def parts_together(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Parts ordered together; src < dst, a weight that follows from the ends. Lines are dealt once, by order."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    pairs = l.select("l_orderkey", F.col("l_partkey").alias("src")).join(l.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").where("src < dst").select("src", "dst")
    return (pairs.distinct() if distinct else pairs).withColumn("weight", F.expr(WEIGHT))


def users_together(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Users of whom one comes after the other on a day; src < dst, a weight that follows from the ends."""
    pairs = user_sequence(spark, sf_dir).where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return (pairs.distinct() if distinct else pairs).withColumn("weight", F.expr(WEIGHT))


def user_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user of an event and that of the next one on the same day, with the event's time in seconds. Self-loops and repeats are there."""
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst"), F.col("event_id").alias("edge_id"), F.unix_timestamp("ts").alias("start_time"), (F.col("event_id") % 3).cast("int").alias("edge_type")).where("dst IS NOT NULL")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree: region to nation (+ 100) to customer (+ 1,000) and supplier (+ 10,000,000)."""
    n, c, s = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    return n.selectExpr("cast(n_regionkey AS bigint) AS src", "n_nationkey + 100L AS dst").unionByName(c.selectExpr("c_nationkey + 100L AS src", "c_custkey + 1000 AS dst")).unionByName(s.selectExpr("s_nationkey + 100L AS src", f"s_suppkey + {SUPPLIER_BASE} AS dst"))


_US = "us AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS dst, event_id AS edge_id, floor(epoch(ts))::BIGINT AS start_time, (event_id % 3)::INTEGER AS edge_type FROM events) WHERE dst IS NOT NULL), ud AS (SELECT DISTINCT src, dst FROM us)"
_BOTH = "ps AS (SELECT src, dst, weight FROM pt UNION ALL SELECT dst, src, weight FROM pt)"

#: The same rows in SQL, as common table expressions.
SQL = {
    "cs": f"cs AS (SELECT DISTINCT o_custkey AS src, l_suppkey + {SUPPLIER_BASE} AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
    "pt": "pt AS (SELECT src, dst, ((src * 31 + dst * 17) % 97 + 1)::DOUBLE AS weight FROM (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)), ps AS (SELECT src, dst, weight FROM pt UNION ALL SELECT dst, src, weight FROM pt)",
    "us": _US,
    "fr": f"{_US}, pt AS (SELECT src, dst, ((src * 31 + dst * 17) % 97 + 1)::DOUBLE AS weight FROM (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM us WHERE src <> dst)), {_BOTH}",
    "geo": f"geo AS (SELECT n_regionkey::BIGINT AS src, n_nationkey + 100::BIGINT AS dst FROM nation UNION ALL SELECT c_nationkey + 100::BIGINT, c_custkey + 1000 FROM customer UNION ALL SELECT s_nationkey + 100::BIGINT, s_suppkey + {SUPPLIER_BASE} FROM supplier)",
}
