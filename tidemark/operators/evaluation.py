"""Scores of probabilities against outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import log_loss
from tidemark.operators import scans
from tidemark.operators.ranks import running_totals


def metrics(df: DataFrame, p: str, y: str, segment: str) -> DataFrame:
    """n, Brier and log-loss over all rows and per segment (segment null: all rows)."""
    t = df.where(F.col(y).isin(0, 1) & F.col(p).isNotNull()).withColumn("_b", (F.col(p) - F.col(y)) ** 2).withColumn("_l", log_loss(p, y))
    return t.groupingSets([[], [F.col(segment)]], F.col(segment)).agg(F.count("*").alias("n"), F.avg("_b").alias("brier"), F.avg("_l").alias("log_loss"))


def ece(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Expected calibration error over bins of equal width, from one row per bin."""
    b = df.withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    b = b.groupBy("_bin").agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    return b.agg(F.sum("n").alias("n"), F.count("*").alias("bins"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def equal_mass_ece(df: DataFrame, p: str, y: str, row_id: str) -> DataFrame:
    """n, bins and expected calibration error over bins of equal mass; null under 36 rows.

    A bin holds 12 rows or more and there are 3 to 10 of them; the first bins take the rows left over. Rows are ranked by
    p, then by id, through the counts of distinct values of p.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(p, y, row_id)
    below = running_totals(rows.groupBy(p).agg(F.count("*").alias("n")), p, ["n"]).select(p, "below_n")
    total = rows.agg(F.count("*").alias("_n")).withColumn("_k", F.greatest(F.lit(3), F.least(F.lit(10), F.floor(F.col("_n") / 12))))
    r = rows.join(below, p).join(F.broadcast(total)).withColumn("_r", F.col("below_n") + F.row_number().over(Window.partitionBy(p).orderBy(row_id)) - 1)  # total is one row
    size, more = F.floor(F.col("_n") / F.col("_k")), F.col("_n") % F.col("_k")
    long = more * (size + 1)
    bin_ = F.when(F.col("_r") < long, F.floor(F.col("_r") / (size + 1))).otherwise(more + F.floor((F.col("_r") - long) / size))
    b = r.groupBy(bin_.alias("_bin"), "_n").agg(F.count("*").alias("c"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return b.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n"), F.count("*").alias("bins"), F.when(F.max("_n") >= 36, F.sum(F.col("c") * F.col("gap")) / F.max("_n")).alias("ece"))


def trailing_ece(df: DataFrame, key: Sequence[str], order: Sequence[str], p: str, y: str, length: int = 64, bins: int = 10) -> DataFrame:
    """Adds trailing_ece: the calibration error of the last `length` rows of a key, null until there are that many."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(length - 1), 0)
    row = F.struct(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("b"), (F.col(p) - F.col(y)).cast("double").alias("d"))
    out = df.withColumn("_rows", F.collect_list(row).over(w))
    gaps = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.abs(F.aggregate(F.col("_rows"), F.lit(0.0), lambda s, r: s + F.when(r["b"] == b, r["d"]).otherwise(0.0))))
    return out.withColumn("trailing_ece", F.when(F.size("_rows") == length, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / length)).drop("_rows")


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Mann-Whitney AUC with ties averaged, from counts of distinct scores; null scores are left out."""
    s = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(y) == 1).alias("up"), F.count_if(F.col(y) == 0).alias("down"))
    s = running_totals(s, score, ["down"])
    return s.agg(F.sum("up").alias("ups"), F.sum("down").alias("downs"), F.try_divide(F.sum(F.col("up") * (F.col("below_down") + F.col("down") / 2)), F.sum("up") * F.sum("down")).alias("auc"))


def regression(df: DataFrame, guess: str, actual: str) -> DataFrame:
    """n, MAE and RMSE over rows with both values."""
    e = F.col(guess) - F.col(actual)
    return df.where(e.isNotNull()).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def classwise_ece(df: DataFrame, classes: dict[str, str], y: str, bins: int = 10) -> DataFrame:
    """ece: the mean over classes of each one's calibration error. classes: the column of each class's probability."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("p"), (F.col(y) == k).cast("int").alias("hit")) for k, c in classes.items()])).alias("r")).select("r.*")
    rows = rows.where("p IS NOT NULL AND hit IS NOT NULL").withColumn("b", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    each = rows.groupBy("k", "b").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("hit")).alias("gap")).groupBy("k").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return each.agg(F.count("*").alias("classes"), F.avg("ece").alias("ece"))


def weighted_scorecard(df: DataFrame, key: Sequence[str], n: str, week: str, losses: dict[str, tuple[str, str]], correct: str) -> DataFrame:
    """Per key: weeks, n, the gain of each loss (market less model, weighted by n) and the share of correct picks.

    Losses are summed as decimals of nine places and divided once, so a gain is the same in whatever order rows come;
    a row without either loss adds nothing to it.
    """
    nano, k = "decimal(18,9)", F.col(n).cast("decimal(10,0)")
    gain = lambda market, model: F.try_divide(F.sum((F.col(market).cast(nano) - F.col(model).cast(nano)) * k).cast("double"), F.sum(n))
    return df.groupBy(*key).agg(F.count_distinct(week).alias("weeks"), F.sum(n).alias("n"), *[gain(*pair).alias(name) for name, pair in losses.items()], F.try_divide(F.sum(correct), F.sum(n)).alias("accuracy"))


def share_interval(share: str, n: str, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a share of n; null for none. Stands for the quantiles of binomial draws."""
    p, k = F.col(share), F.col(n)
    mid, half = p + z * z / (2 * k), z * F.sqrt(p * (1 - p) / k + z * z / (4 * k * k))
    return F.when(k > 0, (mid - half) / (1 + z * z / k)), F.when(k > 0, (mid + half) / (1 + z * z / k))


def paired_gains(one: DataFrame, other: DataFrame, key: Sequence[str], loss: str) -> DataFrame:
    """n, mean and standard error of the differences in loss over the ids that both have."""
    d = one.select(*key, F.col(loss).alias("_a")).join(other.select(*key, F.col(loss).alias("_b")), list(key)).select((F.col("_a") - F.col("_b")).alias("d"))
    return d.agg(F.count("d").alias("n"), F.avg("d").alias("gain"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"))


def drift(df: DataFrame, key: Sequence[str], order: Sequence[str], p: str, y: str, slack: float = 0.02, limit: float = 3.0, length: int = 64, most_ece: float = 0.08, least: int = 32) -> DataFrame:
    """Each row with trailing_ece, cusum_up, cusum_down and drift_alarm, and whether its key has one (triggered).

    An alarm needs `least` rows of the key so far, and a sum over `limit` or a trailing error over `most_ece`.
    """
    rows = scans.cusum_rows(df.withColumn("_r", (F.col(p) - F.col(y)).cast("double")), key, order, "_r", slack, limit).drop("_r")
    rows = trailing_ece(rows, key, order, p, y, length)
    enough = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) >= least
    rows = rows.withColumn("drift_alarm", enough & (F.col("alarm") | (F.coalesce("trailing_ece", F.lit(0.0)) > most_ece)))
    return rows.drop("alarm").withColumn("triggered", F.bool_or("drift_alarm").over(Window.partitionBy(*key)))


def against_market(df: DataFrame, markets: dict[str, tuple[str, str, str]], season: str) -> DataFrame:
    """Per market, over all rows (season null) and per season: both sides' losses, what the model gains, its share of better rows.

    markets: the columns (outcome, model's probability, market's probability) of each. Rows count whose outcome is 0 or 1 and
    that have both probabilities; a row without a season is left out, so that null means all. One pass and one shuffle of partial sums.
    """
    row = lambda k, y, p, q: F.struct(F.lit(k).alias("market"), F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"), F.col(q).cast("double").alias("q"))
    t = df.where(F.col(season).isNotNull()).select(F.col(season).alias("season"), F.explode(F.array(*[row(k, *c) for k, c in markets.items()])).alias("r")).select("season", "r.*")
    t = t.where(F.col("y").isin(0, 1) & F.col("p").isNotNull() & F.col("q").isNotNull())
    loss = {"brier": lambda c: (F.col(c) - F.col("y")) ** 2, "log_loss": lambda c: log_loss(c, "y")}
    g = t.groupingSets([[F.col("market")], [F.col("market"), F.col("season")]], F.col("market"), F.col("season"))
    sides = [F.avg(f(c)).alias(f"{who}_{n}") for n, f in loss.items() for who, c in (("model", "p"), ("market", "q"))]
    out = g.agg(F.count("*").alias("n"), *sides, F.avg((F.abs(F.col("p") - F.col("y")) < F.abs(F.col("q") - F.col("y"))).cast("int")).alias("better"))
    return out.withColumns({f"{n}_gain": F.col(f"market_{n}") - F.col(f"model_{n}") for n in loss})


def margins_against_market(df: DataFrame, actual: str, guess: str, spread: str, season: str) -> DataFrame:
    """As against_market for margins: both mean absolute errors (the market's guess is minus the spread)."""
    model, market = F.abs(F.col(guess) - F.col(actual)), F.abs(-F.col(spread) - F.col(actual))
    t = df.where(F.col(season).isNotNull()).select(F.col(season).alias("season"), model.alias("a"), market.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    g = t.groupingSets([[], [F.col("season")]], F.col("season")).agg(F.count("*").alias("n"), F.avg("a").alias("model_mae"), F.avg("b").alias("market_mae"), F.avg((F.col("a") < F.col("b")).cast("int")).alias("better"))
    return g.withColumn("gain", F.col("market_mae") - F.col("model_mae"))
