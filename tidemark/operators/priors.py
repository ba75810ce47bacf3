"""Shrinkage priors and mixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def empirical_bayes(df: DataFrame, entity: str, group: Sequence[str], value: str, n: str, strength: float, floor: float) -> DataFrame:
    """Entity means shrunk towards the group's: n / (n + strength), and the group's variance between entities (floored)."""
    e = df.where(F.col(value).isNotNull()).groupBy(*group, entity).agg(F.sum(F.col(value) * F.col(n)).alias("_s"), F.sum(n).alias("n"))
    e = e.withColumn("entity_mean", F.try_divide("_s", "n"))
    g = e.groupBy(*group).agg(F.try_divide(F.sum("_s"), F.sum("n")).alias("group_mean"), F.greatest(F.coalesce(F.var_samp("entity_mean"), F.lit(floor)), F.lit(floor)).alias("between"))
    w = F.col("n") / (F.col("n") + strength)
    return e.drop("_s").join(g, list(group)).withColumn("prior_mean", w * F.col("entity_mean") + (1 - w) * F.col("group_mean"))


def mixture(df: DataFrame, key: Sequence[str], weight: str, mean: str, sd: str) -> DataFrame:
    """Mean, variance and entropy of the mixture with normalised weights; weights of zero count for nothing."""
    p = df.where(F.col(weight) > 0)
    t = p.groupBy(*key).agg(
        F.sum(weight).alias("s"), F.sum(F.col(weight) * F.col(mean)).alias("m"), F.sum(F.col(weight) * (F.col(sd) ** 2 + F.col(mean) ** 2)).alias("q"), F.sum(F.col(weight) * F.log(weight)).alias("h"), F.count("*").alias("parts"),
    )
    mu = F.col("m") / F.col("s")
    return t.select(*key, "parts", mu.alias("mixture_mean"), F.greatest(F.lit(0.0), F.col("q") / F.col("s") - mu * mu).alias("mixture_variance"), (F.log("s") - F.col("h") / F.col("s")).alias("entropy"))


def aged(df: DataFrame, entity: str, value: str, amount: str, age: str, half_life: float, bucket: Column, strength: float) -> DataFrame:
    """Entity means weighted by amount and age, shrunk towards the mean of the entity's bucket: prior_mean, weight, bucket_variance.

    A weight is amount * 0.5 ** (age / half_life); rows with nulls count for nothing. `bucket` is an expression over the entity.
    """
    w = F.col(amount) * F.pow(F.lit(0.5), F.col(age) / half_life)
    e = df.dropna(subset=[entity, value, amount, age]).groupBy(entity).agg(F.sum(w).alias("weight"), F.sum(w * F.col(value)).alias("_s"))
    e = e.where("weight > 0").withColumn("_m", F.col("_s") / F.col("weight")).withColumn("bucket", bucket)
    b = e.groupBy("bucket").agg((F.sum("_s") / F.sum("weight")).alias("_mu"), F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("_m") ** 2).alias("_q"))
    share = F.col("weight") / (F.col("weight") + strength)
    j = e.join(b, "bucket")
    return j.select(entity, "bucket", "weight", (share * F.col("_m") + (1 - share) * F.col("_mu")).alias("prior_mean"), F.greatest(F.lit(0.0), F.col("_q") / F.col("_w") - F.col("_mu") ** 2).alias("bucket_variance"))


def push_rates(history: DataFrame, line: str, push: str, strength: float = 50.0, smoothing: float = 0.5, most: float = 0.25) -> DataFrame:
    """(line, n, rate) for whole lines: the share of pushes, pooled towards that of all whole lines. Other lines can't push."""
    h = history.where(F.col(line).isNotNull() & F.col(push).isNotNull() & (F.abs(F.col(line) - F.round(line)) <= 1e-9))
    by = h.groupBy(F.round(line).alias(line)).agg(F.count("*").alias("n"), F.sum(push).alias("_k"))
    whole = by.agg(((F.sum("_k") + smoothing) / (F.sum("n") + 2 * smoothing)).alias("_g"))
    return by.join(F.broadcast(whole)).select(line, "n", F.least(F.lit(most), (F.col("_k") + strength * F.col("_g")) / (F.col("n") + strength)).alias("rate"))  # one row


def overridden(generated: DataFrame, overrides: DataFrame, group: str, member: str, p: str) -> DataFrame:
    """Shares with overrides: (group, member, p, origin). A group's overrides stand as given, what is left of 1 goes to its
    other members by their own shares; groups without overrides stay. Overrides over 1 in a group fail the query."""
    o = overrides.select(group, member, F.col(p).cast("double").alias(p), F.lit("override").alias("origin"))
    sums = o.groupBy(group).agg(F.sum(p).alias("_o"))
    sums = sums.withColumn("_o", F.when(F.col("_o") > 1 + 1e-9, F.raise_error(F.lit("overrides of a group exceed 1")).cast("double")).otherwise(F.col("_o")))
    rest = generated.select(group, member, F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias("_p")).join(o.select(group, member), [group, member], "left_anti").join(sums, group, "left")
    share = F.coalesce(F.try_divide(F.col("_p"), F.sum("_p").over(Window.partitionBy(group))), F.lit(0.0))
    left = rest.select(group, member, F.when(F.col("_o").isNull(), F.col("_p")).otherwise(share * F.greatest(F.lit(0.0), 1 - F.col("_o"))).alias(p), F.lit("generated").alias("origin"))
    return left.unionByName(o.join(sums, group).select(group, member, F.when(F.col("_o").isNotNull(), F.col(p)).alias(p), "origin"))
