"""Leakage-safe sequence operators: every frame ends before the current row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import prefix, scans


def prior_features(df: DataFrame, key: Sequence[str], order: Sequence[str], metrics: Sequence[str], season: str | None = None, last: Sequence[int] = (4, 8)) -> DataFrame:
    """Adds, per metric, mean and count over all earlier rows, the last n and the season so far; the row's own value is
    never in them. `order` must be unique within a key. The first row has null means and zero counts. One sort serves
    all frames of a partitioning."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = {"sequence": (F.row_number().over(w) - 1).cast("long")}
    frames = {"all": w.rowsBetween(Window.unboundedPreceding, -1)} | {f"last{n}": w.rowsBetween(-n, -1) for n in last}
    if season:
        s = Window.partitionBy(*key, season).orderBy(*order)
        out["season_sequence"] = (F.row_number().over(s) - 1).cast("long")
        frames["season"] = s.rowsBetween(Window.unboundedPreceding, -1)
    for m in metrics:
        for name, frame in frames.items():
            out[f"{m}_{name}_mean"] = F.avg(m).over(frame)
            out[f"{m}_{name}_n"] = F.count(m).over(frame)
    return df.withColumns(out)


def ewm_prior(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, half_life: float, name: str) -> DataFrame:
    """Adds the exponentially weighted mean of all earlier rows, as adjust=False with gaps that keep decaying."""
    return prefix.fading_mean(df, key, order, value, half_life, name)


def rest_days(df: DataFrame, key: Sequence[str], order: Sequence[str], time: str, short: float = 6.0) -> DataFrame:
    """Adds rest_days (fractional) since the key's row before and short_rest (0 where there is none)."""
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(Window.partitionBy(*key).orderBy(*order)).cast("timestamp"))) / 86_400_000_000
    return df.withColumn("rest_days", gap).withColumn("short_rest", F.coalesce(F.col("rest_days") < short, F.lit(False)).cast("int"))


def recency_exposure(df: DataFrame, key: Sequence[str], order: Sequence[str], amount: str, cap: float) -> DataFrame:
    """Adds `later`, what the key gathers after the row, and `counted`, how much of the row fits under the cap, newest first."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("later", F.coalesce(F.sum(amount).over(w), F.lit(0.0)))
    return out.withColumn("counted", F.greatest(F.lit(0.0), F.least(F.col(amount), cap - F.col("later"))))


def cusum_alarms(df: DataFrame, key: Sequence[str], order: Sequence[str], residual: str, slack: float, limit: float) -> DataFrame:
    """Per key: rows, alarms of the two-sided sum with reset, and the final sums. A null residual counts as 0."""
    rows = scans.cusum_rows(df.select(*key, *order, F.col(residual).cast("double").alias("_r")), key, order, "_r", slack, limit)
    end = F.max_by(F.struct("cusum_up", "cusum_down", "alarm"), F.struct(*order))
    s = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("alarm").alias("alarms"), end.alias("s"))
    return s.select(*key, "n", "alarms", *[F.when(F.col("s.alarm"), 0.0).otherwise(F.col(f"s.cusum_{d}")).alias(d) for d in ("up", "down")])


def capped_share(df: DataFrame, key: Sequence[str], amount: str, cap: float, name: str) -> DataFrame:
    """Adds the amount scaled down so that the key's total keeps within the cap."""
    total = F.sum(amount).over(Window.partitionBy(*key))
    return df.withColumn(name, F.col(amount) * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(cap), total), F.lit(1.0))))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
