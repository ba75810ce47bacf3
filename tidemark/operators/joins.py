"""Joins by time: nearest within a tolerance, strictly before, mirrored sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_within(left: DataFrame, right: DataFrame, key: Sequence[str], left_id: str, right_id: str, left_time: str, right_time: str, tolerance_s: int) -> DataFrame:
    """Per left row: match id, candidates and status.

    right's columns of `key` have the same names. Statuses: matched, matched_nearest_ambiguous (more than one within the
    tolerance; the nearest, then the least id), outside_tolerance and key_not_found. Time is cut into stretches of the
    tolerance and rows meet in their own and the two next to it, so that only pairs of up to twice the tolerance are
    joined; which keys there are is asked apart.
    """
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    wide = max(1, tolerance_s) * 1_000_000
    r = right.select(*key, F.col(right_id).alias("_rid"), micro(right_time).alias("_rt"))
    near = r.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_rt") / wide) - 1, F.floor(F.col("_rt") / wide) + 1)))
    cells = left.select(left_id, *key, micro(left_time).alias("_lt")).withColumn("_cell", F.floor(F.col("_lt") / wide))
    gap = F.abs(F.col("_lt") - F.col("_rt"))
    hit = gap <= tolerance_s * 1_000_000
    j = cells.join(near, [*key, "_cell"], "left")
    out = j.groupBy(left_id, *key).agg(F.count_if(hit).alias("candidates"), F.min(F.when(hit, F.struct(gap.alias("gap"), F.col("_rid").alias("id")))).alias("best"))
    out = out.join(r.where("_rid IS NOT NULL").select(*key).distinct().withColumn("_key", F.lit(True)), list(key), "left")
    status = F.when(F.col("_key").isNull(), "key_not_found").when(F.col("candidates") == 0, "outside_tolerance").when(F.col("candidates") == 1, "matched").otherwise("matched_nearest_ambiguous")
    return out.select(left_id, F.col("best.id").alias("match_id"), "candidates", status.alias("status"))


def strictly_before(snapshots: DataFrame, history: DataFrame, day: str, history_day: str, aggregates: dict[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """Aggregates over the history of strictly earlier days for each snapshot day, of the same entity if there is a `key`.

    Both sides hold one row per day and entity (history already summed by day), so the pairs number days squared for
    each entity and not rows; the aggregates see them as they are joined.
    """
    h = history.withColumnRenamed(history_day, "_hday").withColumnsRenamed({k: f"_h{k}" for k in key})
    on = F.col("_hday") < F.col(day)
    for k in key:
        on = on & (F.col(k) == F.col(f"_h{k}"))
    return snapshots.join(h, on, "left").groupBy(*key, day).agg(*[c.alias(n) for n, c in aggregates.items()])


def mirrored(df: DataFrame, own: str, other: str, keys: Sequence[str], metrics: Sequence[str], prefix: str) -> DataFrame:
    """df with the metrics of the row whose sides are swapped, under a prefix; null where there is none."""
    swap = df.select(*keys, F.col(own).alias(other), F.col(other).alias(own), *[F.col(m).alias(prefix + m) for m in metrics])
    return df.join(swap, [*keys, own, other], "left")
