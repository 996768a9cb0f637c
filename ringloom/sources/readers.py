"""Sources and sinks: typed readers with their checks, writers with manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_SCHEMA = T.StructType([T.StructField("order_time", T.StringType()), T.StructField("sku_id", T.LongType()), T.StructField("id", T.LongType()), *(T.StructField(f"r{i}", T.DoubleType()) for i in range(1, 9))])
EDGE_SCHEMA = T.StructType([T.StructField("src", T.IntegerType()), T.StructField("dst", T.IntegerType()), *(T.StructField(f"r{i}_score", T.FloatType()) for i in range(1, 9))])
NODE_SCHEMA = T.StructType([T.StructField("user_id", T.IntegerType()), T.StructField("label", T.ByteType())])


def day_ordinal(day):
    """Days since 0001-01-01, which is day 1."""
    return (F.datediff(day, F.expr("DATE'0001-01-01'")) + 1).cast("int")


def ordinal_day(ordinal):
    return F.date_add(F.expr("DATE'0001-01-01'"), ordinal.cast("int") - 1)


def read_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """One order file with its fixed column types."""
    return spark.read.schema(ORDER_SCHEMA).option("header", True).option("ignoreTrailingWhiteSpace", True).option("ignoreLeadingWhiteSpace", True).csv(path)


def assert_empty(df: DataFrame, columns: tuple[str, ...] = ("r2", "r4", "r5")) -> None:
    """Raise unless the columns are null throughout."""
    found = df.agg(*(F.count(c).alias(c) for c in columns)).first().asDict()
    full = [c for c, n in found.items() if n]
    if full:
        raise ValueError(f"columns {full} are not empty")


def load_orders(first: DataFrame, second: DataFrame, cut: str, last: str) -> DataFrame:
    """Two raw files -> week, user_id, sku_id, day_ordinal, r1, r3, r6, r7, r8. Days up to `cut` are
    week 1; rows of the second file on week-1 days are boundary rows and go; the first file may
    have no later day than `last` (checked by the caller with check_days)."""
    typed = lambda df: df.select(F.col("id").cast("int").alias("user_id"), F.col("sku_id").cast("int").alias("sku_id"), F.to_date("order_time").alias("day"), *(F.col(c).cast("long").alias(c) for c in ("r1", "r3", "r6", "r7", "r8")))
    one = typed(first).where(F.col("day") <= F.lit(last).cast("date")).withColumn("week", F.lit(1))
    two = typed(second).where(F.col("day") > F.lit(cut).cast("date")).withColumn("week", F.lit(2))
    return one.unionByName(two).withColumn("day_ordinal", day_ordinal(F.col("day"))).drop("day")


def check_days(first: DataFrame, cut: str) -> None:
    late = first.where(F.to_date("order_time") > F.lit(cut).cast("date")).count()
    if late:
        raise ValueError(f"{late} rows of the first file are later than {cut}")


def load_nodes(nodes: DataFrame) -> DataFrame:
    """user_id, label; raise unless ids are 0..n-1, each once."""
    out = nodes.select(F.col("user_id").cast("int").alias("user_id"), F.col("label").cast("byte").alias("label"))
    r = out.agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"), F.count("*").alias("n"), F.count_distinct("user_id").alias("d")).first()
    if r.n and (r.lo != 0 or r.hi != r.n - 1 or r.d != r.n):
        raise ValueError("ids are not contiguous from 0")
    return out


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE_SCHEMA).option("header", True).csv(path)


def edge_list(edges: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """External edges -> src, dst, weight: the sum of their scores."""
    columns = columns or [f"r{i}_score" for i in range(1, 9)]
    return edges.select("src", "dst", sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)).alias("weight"))


def relation_graph(edges: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """edges(rel, src, dst) of adjacency-only graphs: upper triangle, without dropped
    relations; raise if none is left."""
    left = edges.where((F.col("src") < F.col("dst")) & ~F.col("rel").isin(*drop) if drop else F.col("src") < F.col("dst"))
    if left.isEmpty():
        raise ValueError("no relation is left")
    return left


def transactions(tx: DataFrame, identity: DataFrame) -> DataFrame:
    """Card transactions left-joined with identities, with their day."""
    return tx.join(identity, "TransactionID", "left").withColumn("day", F.floor(F.col("TransactionDT") / 86400).cast("long"))


def write_table(df: DataFrame, path: str, force: bool = True, partition: list[str] | None = None) -> bool:
    """Write zstd parquet; without force, an existing table is left alone. True if written."""
    w = df.write.option("compression", "zstd").mode("overwrite" if force else "ignore")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return force


def manifest(df: DataFrame, numeric: list[str]) -> DataFrame:
    """One row: rows, and for each column its nulls, minimum and maximum, as JSON."""
    cols = [F.struct(F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in numeric]
    return df.agg(F.count("*").alias("rows"), *cols).select(F.to_json(F.struct("*")).alias("manifest"))
