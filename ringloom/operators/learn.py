"""Account scores: boosted trees with balanced classes, isotonic calibration on validation rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.config import SETTINGS


class Scorer:
    """A fitted model: score(features) -> user_id, score (calibrated), raw_score."""

    def __init__(self, columns: list[str], model, calibrator):
        self.columns, self.model, self.calibrator = columns, model, calibrator

    def score(self, features: DataFrame) -> DataFrame:
        x = self.model.transform(VectorAssembler(inputCols=self.columns, outputCol="x").transform(features.fillna(0, self.columns)))
        x = x.withColumn("raw_score", vector_to_array("probability")[1])
        if self.calibrator is None:
            return x.select("user_id", F.col("raw_score").alias("score"), "raw_score")
        x = self.calibrator.transform(x.withColumnRenamed("prediction", "__class"))
        return x.select("user_id", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"), "raw_score")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")


def fit(features: DataFrame, folds: DataFrame, columns: list[str], trees: int = 40, depth: int = 5, rate: float = 0.1, seed: int = SETTINGS.seed) -> Scorer:
    """folds(user_id, label, fold): trees grow on train, stop and are calibrated on val."""
    x = features.select("user_id", *columns).fillna(0).join(folds.where("fold in ('train', 'val')"), "user_id")
    n = {r.label: r.n for r in x.where("fold = 'train'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("label") == 1, n.get(0, 1) / max(n.get(1, 1), 1)).otherwise(1.0)
    x = VectorAssembler(inputCols=columns, outputCol="x").transform(x).withColumn("w", weight).withColumn("validate", F.col("fold") == "val").withColumn("y", F.col("label").cast("double"))
    model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, validationIndicatorCol="validate", seed=seed).fit(x.select("x", "y", "w", "validate"))
    val = model.transform(x.where("validate")).withColumn("raw_score", vector_to_array("probability")[1]).select("y", "raw_score")
    calibrator = None if val.isEmpty() else IsotonicRegression(featuresCol="raw_score", labelCol="y").fit(val)
    return Scorer(columns, model, calibrator)


def out_of_fold(features: DataFrame, pool: DataFrame, columns: list[str], folds: int = 5, **kw) -> DataFrame:
    """user_id, score: each pool(user_id, label) account by a model of the other folds."""
    part = pool.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(folds)))
    out = None
    for i in range(folds):
        train = part.where(F.col("part") != i).select("user_id", "label", F.when(F.pmod(F.xxhash64(F.lit(1), "user_id"), F.lit(5)) == 0, "val").otherwise("train").alias("fold"))
        got = fit(features, train, columns, **kw).score(features.join(part.where(F.col("part") == i).select("user_id"), "user_id", "left_semi")).select("user_id", "score")
        out = got if out is None else out.unionByName(got)
    return out
