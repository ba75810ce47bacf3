"""Expanding folds: each season is scored by a model that saw earlier seasons only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def model(kind: str, inputs: Sequence[str], y: str, **how) -> Pipeline:
    """logistic (ridge penalty `l2`) or trees (gradient boosting); nulls must be gone."""
    fit = {"logistic": lambda: LogisticRegression(featuresCol="_x", labelCol=y, regParam=how.get("l2", 0.01)), "trees": lambda: GBTClassifier(featuresCol="_x", labelCol=y, maxIter=how.get("rounds", 20), maxDepth=how.get("depth", 3), seed=7)}
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), fit[kind]()])


def expanding(df: DataFrame, season: str, inputs: Sequence[str], y: str, keep: Sequence[str], kind: str = "logistic", least_rows: int = 50, calibrate: bool = False, **how) -> DataFrame:
    """keep, season, y and p for every season with `least_rows` earlier rows of both outcomes.

    With calibrate the latest earlier season is held back from the fit, and an isotonic curve on it bends the scores
    (where there are two earlier seasons or more). Seasons are few: they are listed on the driver. Rows with nulls are
    left out.
    """
    rows = df.select(*keep, season, *[F.col(c).cast("double").alias(c) for c in inputs], F.col(y).cast("double").alias(y)).dropna(subset=[season, y, *inputs])
    counts = {r[season]: (r["n"], r["up"]) for r in rows.groupBy(season).agg(F.count("*").alias("n"), F.sum(y).alias("up")).collect()}
    out = []
    for s in sorted(counts):
        before = [t for t in counts if t < s]
        n, up = sum(counts[t][0] for t in before), sum(counts[t][1] for t in before)
        if n < least_rows or up in (0, n):
            continue
        held = max(before) if calibrate and len(before) > 1 else None
        if held is not None and n - counts[held][0] <= up - counts[held][1] or held is not None and up == counts[held][1]:
            held = None  # what is left to fit on has one outcome
        fitted = model(kind, inputs, y, **how).fit(rows.where(F.col(season) < (s if held is None else held)))
        score = lambda d, f=fitted: f.transform(d).withColumn("p", vector_to_array("probability")[1]).drop("_raw", "_x", "rawPrediction", "probability", "prediction")
        scored = score(rows.where(F.col(season) == s))
        if held is not None:
            curve = IsotonicRegression(featuresCol="p", labelCol=y).fit(score(rows.where(F.col(season) == held)))
            scored = curve.transform(scored).withColumn("p", F.col("prediction")).drop("prediction")
        out.append(scored.select(*keep, season, y, "p"))
    if not out:
        return rows.select(*keep, season, y, F.lit(None).cast("double").alias("p")).where("false")
    whole = out[0]
    for d in out[1:]:
        whole = whole.unionByName(d)
    return whole
