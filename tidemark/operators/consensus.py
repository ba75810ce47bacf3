"""Consensus over many sources: paired sides, medians, robust outliers, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 0.67448975


def devig(df: DataFrame, key: Sequence[str], implied: str) -> DataFrame:
    """Adds fair_probability and overround: shares of the group's implied probabilities."""
    total = F.sum(implied).over(Window.partitionBy(*key))
    return df.withColumn("fair_probability", F.try_divide(F.col(implied), total)).withColumn("overround", total - 1)


def mad_outliers(df: DataFrame, key: Sequence[str], value: str, limit: float, tolerance: float, least: int = 2) -> DataFrame:
    """Adds is_outlier by scaled distance from the group's median; where the median distance vanishes, by the tolerance."""
    w = Window.partitionBy(*key)
    out = df.withColumn("_med", F.median(value).over(w)).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    out = out.withColumn("_mad", F.median("_dev").over(w)).withColumn("_n", F.count(value).over(w))
    hit = F.when(F.col("_mad") <= 1e-12, F.col("_dev") > tolerance).otherwise(MAD_SCALE * F.col("_dev") / F.col("_mad") > limit)
    return out.withColumn("is_outlier", F.coalesce(hit & (F.col("_n") >= least), F.lit(False)).cast("int")).drop("_med", "_dev", "_mad", "_n")


def consensus(df: DataFrame, key: Sequence[str], value: str, source: str, least: int) -> DataFrame:
    """Median, population deviation and sources per key; keys with fewer than `least` sources are left out."""
    out = df.groupBy(*key).agg(F.median(value).alias("median_value"), F.stddev_pop(value).alias("dispersion"), F.count_distinct(source).alias("sources"))
    return out.where(F.col("sources") >= least)


def freshness(df: DataFrame, age_s: str, value: str, most_age: int, low: float, high: float) -> DataFrame:
    """Adds reasons (sorted, joined by |) and eligible."""
    why = F.array_compact(F.array(
        F.when(F.col(age_s) > most_age, "STALE"), F.when(F.col(age_s) < 0, "FUTURE"), F.when(F.col(value).isNull(), "MISSING"),
        F.when(F.col(value) < low, "TOO_LOW"), F.when(F.col(value) > high, "TOO_HIGH"),
    ))
    return df.withColumn("reasons", F.array_join(F.array_sort(why), "|")).withColumn("eligible", (F.size(why) == 0).cast("int"))


def modal(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per key, the least of equals, and how often it comes; counted by value first."""
    n = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*key).agg(F.max(F.struct("n", (-F.col(value)).alias("_v"))).alias("b"))
    return best.select(*key, (-F.col("b._v")).alias("mode_value"), F.col("b.n").alias("n"))


def paired_consensus(df: DataFrame, key: Sequence[str], source: str, side: str, sides: tuple[str, str], price: str) -> DataFrame:
    """Per key: median fair probability of the first side, its population deviation, median hold and sources that quote both sides.

    A source's greatest price per side counts; sources with one side or a price of zero or less are left out.
    """
    one, two = F.col(sides[0]), F.col(sides[1])
    both = df.groupBy(*key, source).pivot(side, list(sides)).agg(F.max(price)).where((one > 0) & (two > 0))
    both = both.select(*key, (one / (one + two)).alias("p"), (one + two).alias("h"))
    return both.groupBy(*key).agg(F.median("p").alias("fair_probability"), F.stddev_pop("p").alias("dispersion"), F.median("h").alias("hold"), F.count("*").alias("sources"))


def compared(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Both results side by side: key, old, new, change and where the key is found (both, old_only, new_only)."""
    a, b = old.select(*key, F.col(value).alias("old"), F.lit(1).alias("_a")), new.select(*key, F.col(value).alias("new"), F.lit(1).alias("_b"))
    j = a.join(b, list(key), "full_outer")
    found = F.when(F.col("_b").isNull(), "old_only").when(F.col("_a").isNull(), "new_only").otherwise("both")
    return j.select(*key, "old", "new", (F.col("new") - F.col("old")).alias("change"), found.alias("found"))
