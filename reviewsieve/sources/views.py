"""Review tables derived from the given parquet tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Review texts composed from order keys; the same statement runs in Spark and in DuckDB.
REVIEWS_ORDERS_SQL = """
WITH k AS (
  SELECT o_orderkey AS review_id, o_custkey AS product_id,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL
              ELSE CAST(1 + (o_orderkey * 7 + o_custkey) % 5 AS DOUBLE) END AS rating,
         CASE WHEN o_orderkey % 7 < 3 THEN 1 ELSE 0 END AS label,
         split_part('battery;sound quality;volume;screen;price;hinge;bluetooth;build quality', ';', CAST(1 + (o_orderkey * 13 + o_custkey * 5) % 8 AS INT)) AS a1,
         split_part('strap;bass;charger;packaging;design;lid;support;size', ';', CAST(1 + (o_orderkey * 3 + o_custkey) % 8 AS INT)) AS a2,
         split_part('good;really disappointing;not bad;excellent;too low;just ok;not very good;fine', ';', CAST(1 + (o_orderkey * 5 + o_custkey * 3) % 8 AS INT)) AS j1,
         split_part('weak;very solid;flimsy;decent;broken;great;kinda slow;comfortable', ';', CAST(1 + (o_orderkey * 11 + o_custkey) % 8 AS INT)) AS j2,
         split_part('amazing;excellent;fantastic;incredible', ';', CAST(1 + (o_orderkey + o_custkey) % 4 AS INT)) AS s1,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 2 AS VARCHAR(10)) AS n1
  FROM {orders})
SELECT product_id, review_id, rating, label,
  CASE WHEN review_id % 97 = 0 THEN ''
       WHEN label = 1 THEN concat('Simply ', s1, '! Nothing beats the ', a1, ', it is ', s1, ' in every way. My whole family wants one and you should highly consider it too.')
       WHEN review_id % 3 = 0 THEN concat('the ', a1, ' is ', j1, ' but the ', a2, ' is ', j2, '. used it for ', n1, ' weeks, i think')
       WHEN review_id % 3 = 1 THEN concat('Great ', a1, ', ', j2, ' ', a2, ', returned it after ', n1, ' days. Its ', a2, ' was ', j1, ' though.')
       ELSE concat('ok so my ', a1, ' seems ', j1, '; ', a2, ' could be better!! sooo ', j2, '. Would you buy it?') END AS text
FROM k
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table of few files over all cores; text work is heavy for its bytes.

    A table with a file per core or more is read as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def reviews_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per order, one product per customer; exercises sentiment and aspects."""
    return spark.sql(REVIEWS_ORDERS_SQL, orders=spread(table(spark, sf_dir, "orders"), "o_orderkey"))


def reviews_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document, one product per source; multilingual, partly labelled."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("source").alias("product_id"), F.col("doc_id").alias("review_id"),
        (1 + F.col("doc_id") % 5).cast("double").alias("rating"), F.col("toxic").alias("label"),
        F.col("lang").alias("category"), "text")


def reviews_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per conversation turn, one product per conversation; no ratings."""
    return spread(table(spark, sf_dir, "conversations"), "conv_id").select(
        F.col("conv_id").alias("product_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"),
        F.lit(None).cast("double").alias("rating"), "text")
