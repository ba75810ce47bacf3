"""A ledger of out-of-fold forecasts in overlapping populations, and paired scores of model and market in each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import log_loss


def ledger(forecasts: DataFrame, populations: Mapping[str, Column], markets: Mapping[str, tuple[str, str, Column, Column]], keep: Sequence[str]) -> DataFrame:
    """One row per forecast, population that it is in and market: keep, population, market, p, q, y, excluded, match.

    populations: names and conditions over the forecasts, which may overlap; one expand makes all rows, the table is read
    once. markets: names and (model's probability, market's probability, outcome 0/1, whether it is a push or tie). match is
    MATCHED where the market has a probability, else NO_QUOTE; y is null where excluded or unknown.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    in_ = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(n)) for n, cond in populations.items()]))
    rows = [F.struct(F.lit(n).alias("market"), number(p).alias("p"), number(q).alias("q"), F.when(~F.coalesce(out, F.lit(False)), y).cast("double").alias("y"), F.coalesce(out, F.lit(False)).alias("excluded")) for n, (p, q, y, out) in markets.items()]
    t = forecasts.select(*keep, F.explode(in_).alias("population"), F.array(*rows).alias("_m"))
    t = t.select(*keep, "population", F.explode("_m").alias("_r")).select(*keep, "population", "_r.*")
    return t.withColumn("match", F.when(F.col("q").isNotNull(), "MATCHED").otherwise("NO_QUOTE"))


def paired_scores(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Per population and market: counts, both sides' losses, what the model gains with its standard error, and both errors of calibration.

    Losses count rows that have an outcome and both probabilities, so they are of the same rows; gain is the market's log
    loss less the model's, better the share of rows where the model's is lower.
    """
    key = ["population", "market"]
    good = F.col("y").isin(0.0, 1.0) & F.col("p").isNotNull() & F.col("q").isNotNull()
    t = rows.withColumn("_g", F.coalesce(good, F.lit(False))).withColumns({f"_l{c}": log_loss(c, "y") for c in "pq"})
    on = lambda c: F.when(F.col("_g"), c)
    d = F.col("_lq") - F.col("_lp")
    whole = t.groupBy(*key).agg(
        F.count("*").alias("rows"), F.count_if("excluded").alias("excluded"), F.count_if(F.col("match") == "NO_QUOTE").alias("unmatched"), F.count_if("_g").alias("graded"),
        *[F.avg(on(F.col(f"_l{c}"))).alias(f"{who}_log_loss") for who, c in (("model", "p"), ("market", "q"))], *[F.avg(on((F.col(c) - F.col("y")) ** 2)).alias(f"{who}_brier") for who, c in (("model", "p"), ("market", "q"))],
        F.avg(on(d)).alias("gain"), (F.stddev_samp(on(d)) / F.sqrt(F.count_if("_g"))).alias("gain_se"), F.avg(on((d > 0).cast("int"))).alias("better"), F.avg(on(F.col("y"))).alias("base_rate"),
    )
    each = t.where("_g").select(*key, "y", F.explode(F.array(*[F.struct(F.lit(who).alias("who"), F.col(c).alias("v")) for who, c in (("model", "p"), ("market", "q"))])).alias("s")).select(*key, "y", "s.*")
    each = each.groupBy(*key, "who", F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).alias("_b")).agg(F.count("*").alias("n"), F.abs(F.avg("v") - F.avg("y")).alias("gap"))
    ece = each.groupBy(*key).agg(*[(F.sum(F.when(F.col("who") == who, F.col("n") * F.col("gap"))) / F.sum(F.when(F.col("who") == who, F.col("n")))).alias(f"{who}_ece") for who in ("model", "market")])
    return whole.join(ece, key, "left")


def left_out(rows: DataFrame, unit: str) -> DataFrame:
    """Per population, market and value of `unit`: the gain over all graded rows but that unit's, as totals less the unit's."""
    good = F.col("y").isin(0.0, 1.0) & F.col("p").isNotNull() & F.col("q").isNotNull()
    t = rows.where(good).groupBy("population", "market", unit).agg(F.count("*").alias("_n"), F.sum(log_loss("q", "y") - log_loss("p", "y")).alias("_s"))
    whole = t.groupBy("population", "market").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
    return t.join(whole, ["population", "market"]).select("population", "market", unit, (F.col("n") - F.col("_n")).alias("others"), F.try_divide(F.col("s") - F.col("_s"), F.col("n") - F.col("_n")).alias("gain_without"))
