"""Selection over seasons: choices that see earlier seasons only, and gates on gains per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import log_loss


def spread_by_season(df: DataFrame, season: str, residual: str, grid: Sequence[float]) -> DataFrame:
    """(season, n, sigma, loss): for each season the spread on the grid that fits all earlier seasons best.

    loss is the mean normal log-loss of those seasons; of equal losses the least sigma counts. Rows are summed by season first.
    """
    s = df.where(F.col(residual).isNotNull()).groupBy(season).agg(F.count("*").alias("n"), F.sum(F.col(residual) ** 2).alias("_q"))
    w = Window.orderBy(season).rowsBetween(Window.unboundedPreceding, -1)  # one row per season
    s = s.select(season, F.sum("n").over(w).alias("n"), F.sum("_q").over(w).alias("_q")).where("n > 0")
    g = s.withColumn("sigma", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    loss = F.log("sigma") + 0.9189385332046727 + F.col("_q") / (F.col("n") * 2 * F.col("sigma") ** 2)
    best = g.groupBy(season, "n").agg(F.min(F.struct(F.round(loss, 9).alias("loss"), F.col("sigma").alias("sigma"))).alias("b"))
    return best.select(season, "n", "b.sigma", "b.loss")


def anchor_source(df: DataFrame, source: str, season: str, p: str, y: str, least_rows: int, least_seasons: int) -> DataFrame:
    """The source with the least log-loss for each season, judged on earlier seasons with enough rows; ties to the least name."""
    s = df.withColumn("_loss", log_loss(p, y)).groupBy(source, season).agg(F.count("*").alias("_k"), F.sum("_loss").alias("_l"))
    w = Window.partitionBy(source).orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    every = s.select(season).distinct().join(s.select(source).distinct())  # seasons by sources: summed rows
    t = every.join(s, [season, source], "left").select(season, source, F.sum("_k").over(w).alias("_k"), F.sum("_l").over(w).alias("_l"), F.count("_k").over(w).alias("_seasons"))
    t = t.where((F.col("_k") >= least_rows) & (F.col("_seasons") >= least_seasons))
    best = t.groupBy(season).agg(F.min(F.struct(F.round(F.col("_l") / F.col("_k"), 9).alias("loss"), F.col(source).alias("source"))).alias("b"))
    return best.select(season, F.col("b.source").alias("anchor"), F.col("b.loss").alias("loss"))


def stability(folds: DataFrame, model: str, fold: str, loss: str, baseline: str, least_gain: float, least_wins: int, most_regress: float) -> DataFrame:
    """Per model: folds, mean and worst gain over the baseline's loss, folds won, whether it qualifies and what failed."""
    base = folds.where(F.col(model) == baseline).select(fold, F.col(loss).alias("_base"))
    g = folds.where(F.col(model) != baseline).join(base, fold, "left").withColumn("_gain", F.col("_base") - F.col(loss))
    a = g.groupBy(model).agg(F.count_distinct(fold).alias("folds"), F.avg("_gain").alias("mean_gain"), F.min("_gain").alias("worst_gain"), F.count_if(F.col("_gain") > 0).alias("won"))
    failed = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("mean_gain") > least_gain, F.lit(False)), "MEAN_NOT_BETTER"), F.when(F.col("won") < least_wins, "TOO_FEW_FOLDS_WON"),
        F.when(~F.coalesce(F.col("worst_gain") >= -most_regress, F.lit(False)), "ONE_FOLD_TOO_BAD"),
    ))
    return a.withColumn("qualifies", (F.size(failed) == 0).cast("int")).withColumn("reasons", F.when(F.size(failed) == 0, "PASS").otherwise(F.array_join(failed, "|")))


def leave_one_out(df: DataFrame, key: Sequence[str], season: str, value: str) -> DataFrame:
    """Means of each key without one season at a time (total less the season), and whether their sign stays that of the whole."""
    s = df.where(F.col(value).isNotNull()).groupBy(*key, season).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy(*key)
    t = s.withColumn("_ts", F.sum("_s").over(w)).withColumn("_tn", F.sum("_n").over(w))
    rest = F.try_divide(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n"))
    return t.select(*key, season, rest.alias("mean_without"), (F.signum(rest) == F.signum(F.col("_ts").cast("double"))).cast("int").alias("same_sign"))
