"""The card-transaction arm: account fingerprints, relations, labels and window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, columns: tuple[str, ...] = ("card1", "card2", "card3", "card5", "addr1", "addr2")) -> DataFrame:
    """Adds account: a dense number of the fingerprint, by sorted value; nulls are na."""
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("na")) for c in columns))
    x = df.withColumn("__key", key)
    number = x.select("__key").distinct().withColumn("account", F.dense_rank().over(Window.orderBy("__key")) - 1)
    return x.join(number, "__key").drop("__key")


def distance_band(d):
    """0..4 for (-1, 0], (0, 5], (5, 25], (25, 100], (100, 1e9]; null outside."""
    return F.when(d.isNull() | (d <= -1) | (d > 1e9), None).when(d <= 0, 0).when(d <= 5, 1).when(d <= 25, 2).when(d <= 100, 3).otherwise(4)


def relations(df: DataFrame) -> DataFrame:
    """Adds device, purchaser, recipient, place and browser; empty marks are null. A half-known
    device or place is still one."""
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = lambda x: F.when(x.isin("", "|", "nan|nan"), None).otherwise(x)
    band = F.coalesce(distance_band(F.col("dist1")).cast("string"), F.lit(""))
    place = none(F.concat(e("addr1"), F.lit("|"), band))
    return df.withColumn("device", none(F.concat(e("DeviceInfo"), F.lit("|"), e("DeviceType")))).withColumn("purchaser", none(e("P_emaildomain"))).withColumn("recipient", none(e("R_emaildomain"))).withColumn("place", place).withColumn("browser", none(e("id_31")))


def drop_common(df: DataFrame, most: int = 5000) -> DataFrame:
    """Rows of accounts with at most so many transactions."""
    ok = df.groupBy("account").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("account")
    return df.join(ok, "account", "left_semi")


def account_labels(df: DataFrame, share: float = 0.5) -> DataFrame:
    """account, label: 1 where at least a share of transactions is fraud."""
    return df.groupBy("account").agg((F.avg("isFraud") >= share).cast("int").alias("label"))


def window_features(df: DataFrame) -> DataFrame:
    """account, n_tx, amounts, active days; means of counters divide by rows, nulls being 0."""
    means = [c for c in df.columns if (c[0] in "CD" and c[1:].isdigit())]
    return df.groupBy("account").agg(F.count("*").alias("n_tx"), F.sum("TransactionAmt").alias("amount_sum"), F.avg("TransactionAmt").alias("amount_mean"), F.max("TransactionAmt").alias("amount_max"), F.count_distinct("day").alias("active_days"), *(F.avg(F.coalesce(F.col(c), F.lit(0))).alias(f"mean_{c}") for c in means))
