"""Bootstrap by hash: weights follow from the draw and the cluster, so every run and every cluster agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities of 0 to 5 in units of 2 ** -32: the count of a cluster in one draw.
STEPS = (1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291)


def hash_of(draw: Column, cluster: Column) -> Column:
    """The first 32 bits of an md5 of draw and cluster, as eight hex digits."""
    return F.substring(F.md5(F.concat_ws("|", draw.cast("string"), cluster)), 1, 8)


def draws_of(u: Column) -> Column:
    """How often a cluster comes in a draw: Poisson(1) from hash_of's digits.

    Eight hex digits have the order of their number, so they are compared as text and nothing is parsed per draw. `u`
    should be a column of its own, so that the md5 is made once.
    """
    count = F.lit(len(STEPS))
    for k in reversed(range(len(STEPS))):
        count = F.when(u < f"{STEPS[k]:08x}", k).otherwise(count)
    return count.cast("long")


def draws_of_sql(draw: str, cluster: str) -> str:
    u = f"('0x' || substr(md5({draw} || '|' || {cluster}), 1, 8))::BIGINT"
    return "(" + " + ".join(f"({u} >= {s})::BIGINT" for s in STEPS) + ")"


def bootstrap(df: DataFrame, value: str, cluster: Sequence[str], draws: int, low: float, high: float, strata: Sequence[str] = ()) -> DataFrame:
    """mean, low and high of the mean of `value` under resampling of clusters.

    Rows are summed by cluster first, so what is drawn from is one row per cluster. With strata each stratum keeps its
    share of the rows: its resampled mean counts by the rows it has. Draws that catch no cluster (of a stratum) leave it
    out. Null values are left out.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*cluster, *[s for s in strata if s not in cluster]).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    c = c.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    c = c.withColumn("_u", hash_of(F.col("draw"), F.concat_ws("|", *[F.col(x).cast("string") for x in cluster])))
    c = c.withColumn("_k", draws_of(F.col("_u")))
    part = c.groupBy("draw", *strata).agg(F.sum(F.col("_k") * F.col("_s")).alias("s"), F.sum(F.col("_k") * F.col("_n")).alias("n"), F.sum("_n").alias("w"), F.sum("_s").alias("t")).where("n > 0")
    d = part.groupBy("draw").agg((F.sum(F.col("s") / F.col("n") * F.col("w")) / F.sum("w")).alias("m"), (F.sum("t") / F.sum("w")).alias("mean"))
    return d.agg(F.count("*").alias("draws"), F.max("mean").alias("mean"), F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))
