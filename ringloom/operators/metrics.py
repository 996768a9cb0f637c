"""Splits, ranking metrics and relation lifts. An unknown label (-1) never counts as normal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.config import RELATIONS, SETTINGS

from .running import hash_bucket, running_sum


def hash_rank(seed: int, column: str):
    """md5 of seed and id: a reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def split(nodes: DataFrame, held_out: float = SETTINGS.held_out, validation: float = SETTINGS.validation, seed: int = SETTINGS.seed) -> DataFrame:
    """user_id, label, fold (test, val, train): stratified, disjoint by account. Of each label's
    accounts in hash order the first part is held out, then a part of the rest validates."""
    known = nodes.where("label >= 0").select("user_id", "label", hash_rank(seed, "user_id").alias("h"), F.lit(1).alias("one"))
    x = running_sum(known, "one", hash_bucket("h"), ["h", "user_id"], ("label",), "r").withColumnRenamed("r_total", "n")
    test = F.bround(F.col("n") * held_out, 0)
    val = F.bround((F.col("n") - test) * validation, 0)
    return x.select("user_id", "label", F.when(F.col("r") <= test, "test").when(F.col("r") <= test + val, "val").otherwise("train").alias("fold"))


def label_subsets(train: DataFrame, fractions: tuple[float, ...], seed: int = SETTINGS.seed) -> DataFrame:
    """fraction, user_id, label: nested stratified parts of train(user_id, label), hash order."""
    one = train.select("user_id", "label", hash_rank(seed, "user_id").alias("h"), F.lit(1).alias("one"))
    x = running_sum(one, "one", hash_bucket("h"), ["h", "user_id"], ("label",), "r").withColumnRenamed("r_total", "n")
    return x.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions)))).where(F.col("r") <= F.greatest(F.bround(F.col("n") * F.col("fraction"), 0), F.lit(1))).select("fraction", "user_id", "label")


def steps(scored: DataFrame) -> DataFrame:
    """scored(label 0/1, score) -> score, tp, fp, precision, recall and the recall gained (step) at
    each distinct score and above. Rows are added up per score first; the running sums go by steps of the score."""
    g = scored.where("label >= 0").groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("p"), (F.count("*") - F.sum(F.col("label").cast("long"))).alias("q"))
    step, order = -F.floor(F.col("score") * 4096), [F.desc("score")]
    x = running_sum(running_sum(g, "p", step, order, name="tp"), "q", step, order, name="fp").withColumnRenamed("tp_total", "all")
    return x.select("score", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).alias("recall"), F.when(F.col("all") > 0, F.col("p") / F.col("all")).alias("step"))


def curve(scored: DataFrame) -> DataFrame:
    """The precision-recall curve: score, tp, fp, precision, recall, equal scores as one point."""
    return steps(scored).drop("step")


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: average_precision (steps, not trapezoids; null with one class), positives, negatives."""
    x = steps(scored)
    one = x.agg(F.sum(F.col("step") * F.col("precision")).alias("ap"), F.max("tp").alias("positives"), F.max("fp").alias("negatives"))
    return one.select(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("ap")).alias("average_precision"), "positives", "negatives")


def binary_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row of confusion metrics; flagged means score >= threshold."""
    f, y = F.col("score") >= threshold, F.col("label") == 1
    c = scored.where("label >= 0").agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn"), F.count_if(~f & ~y).alias("tn"))
    safe = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"), F.when(F.col("tp") > 0, F.col("fp") / F.col("tp")).alias("fp_per_tp"))


def operating_points(scored: DataFrame, targets: tuple[float, ...] = (0.80, 0.90, 0.95)) -> DataFrame:
    """target, threshold: the lowest score whose precision reaches the target, null if none."""
    c = curve(scored)
    t = c.sparkSession.createDataFrame([(float(x),) for x in targets], "target double")
    return t.join(c, F.col("precision") >= F.col("target"), "left").groupBy("target").agg(F.min("score").alias("threshold"))


def best_f1(scored: DataFrame) -> DataFrame:
    """One row: threshold, f1: the best F1, the lowest threshold of equals."""
    c = curve(scored).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    return c.select("score", F.round("f1", 9).alias("f1")).orderBy(F.desc("f1"), "score").limit(1).select(F.col("score").alias("threshold"), "f1")


def flag_threshold(scored: DataFrame, budget: int) -> DataFrame:
    """One row: the score of the budget-th account from the top."""
    return scored.select("score").orderBy(F.desc("score")).limit(budget).agg(F.min("score").alias("threshold"))


def precision_at_k(scored: DataFrame, ks: tuple[int, ...] = (100, 500, 1000, 5000)) -> DataFrame:
    """k, labelled, fraud, precision over labelled accounts of the top k."""
    top = scored.orderBy(F.desc("score"), "user_id").limit(max(ks))
    x = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "user_id"))).withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("r <= k")
    return x.groupBy("k").agg(F.count_if(F.col("label") >= 0).alias("labelled"), F.count_if(F.col("label") == 1).alias("fraud")).withColumn("precision", F.when(F.col("labelled") > 0, F.col("fraud") / F.col("labelled")))


def relation_lift(edges: DataFrame, visible: DataFrame, least: int = 500, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """rel, pairs, ff_rate, p, lift, alpha for edges(src, dst, relation_mask) between visible(user_id,
    label) accounts: how much oftener both ends are fraud than by chance; alpha is lift over the mean
    of measured relations, and 1 for those with fewer pairs than `least`. A measured relation without
    fraud has lift 1."""
    a = visible.select(F.col("user_id").alias("src"), F.col("label").cast("double").alias("l1"))
    b = visible.select(F.col("user_id").alias("dst"), F.col("label").cast("double").alias("l2"))
    e = edges.select("src", "dst", "relation_mask").join(a, "src").join(b, "dst")
    bits = F.array(*(F.struct(F.lit(r).alias("rel"), F.lit(i).alias("bit")) for i, r in enumerate(relations)))
    per = e.select("relation_mask", "l1", "l2", F.explode(bits).alias("x")).where("(shiftright(relation_mask, x.bit) & 1) = 1")
    s = per.groupBy("x.rel").agg(F.count("*").alias("pairs"), F.avg(F.col("l1") * F.col("l2")).alias("ff_rate"), F.avg((F.col("l1") + F.col("l2")) / 2).alias("p"))
    every = edges.sparkSession.createDataFrame([(r,) for r in relations], "rel string").join(s, "rel", "left").fillna(0, ["pairs"])
    lift = F.when(F.col("pairs") >= least, F.when(F.col("p") > 0, F.col("ff_rate") / (F.col("p") * F.col("p"))).otherwise(1.0))
    x = every.withColumn("lift", lift).withColumn("mean", F.avg("lift").over(Window.partitionBy()))
    return x.select("rel", "pairs", "ff_rate", "p", "lift", F.coalesce(F.when(F.col("mean") > 0, F.col("lift") / F.col("mean")), F.lit(1.0)).alias("alpha"))


def gains(points: DataFrame, order: str, value: str, least: float = 0.01) -> DataFrame:
    """Adds gain to the next-lower point and plateau: from here on no gain reaches `least`."""
    w = Window.orderBy(order)
    x = points.withColumn("gain", F.col(value) - F.lag(value).over(w))
    return x.withColumn("plateau", F.coalesce(F.max("gain").over(w.rowsBetween(1, Window.unboundedFollowing)) < least, F.lit(True)))
