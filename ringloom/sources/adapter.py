"""The order stream and account table over the star-schema tables.

orders joined with their line items are an order stream: the customer is the account, the part
the sku, and five relations are keys of different rarity. A deterministic score stands in where
no model is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, sku_id, day_ordinal, r1, r3, r6, r7, r8."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_shipdate")
    months = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("sku_id"),
        (F.datediff("o_orderdate", F.expr("DATE'0001-01-01'")) + 1).cast("long").alias("day_ordinal"),
        (F.col("l_suppkey") * 1000 + months).alias("r1"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("r3"),
        F.when(F.col("l_discount") > 0.05, F.col("l_partkey")).alias("r6"),
        F.col("l_suppkey").alias("r7"),
        (F.col("l_suppkey") * 100000 + F.datediff("l_shipdate", F.expr("DATE'1995-01-01'"))).alias("r8"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, label (-1 unknown, 0 normal, 1 fraud), score."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("user_id"),
        F.when(c % 3 == 0, -1).when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("label"),
        (((c * 7919 + 104729) % 1000) / 1000.0).alias("score"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, entity (event type and the props' k), seconds."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")).alias("entity"), F.unix_timestamp("ts").alias("seconds"))


#: The same as DuckDB CTEs.
SQL = """
orders_ as (
  select o_custkey as user_id, l_partkey as sku_id, datediff('day', date '0001-01-01', o_orderdate::date) + 1 as day_ordinal,
         l_suppkey * 1000 + (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as r1, l_partkey * 100000 + l_suppkey as r3,
         case when l_discount > 0.05 then l_partkey end as r6, l_suppkey as r7,
         l_suppkey * 100000 + datediff('day', date '1995-01-01', l_shipdate::date) as r8
  from orders join lineitem on o_orderkey = l_orderkey),
accounts_ as (
  select c_custkey as user_id, case when c_custkey % 3 = 0 then -1 when c_acctbal < 0 then 1 else 0 end as label,
         ((c_custkey * 7919 + 104729) % 1000) / 1000.0::double as score
  from customer)"""
