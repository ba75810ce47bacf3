"""Probabilities to prices, stakes and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.prices import offered_decimal, three_regions
from tidemark.functions.scalars import normal_cdf, number


def kelly(p: Column, decimal: Column, push: Column | None = None) -> Column:
    """Full Kelly share of the bank, no less than zero; null odds or odds of 1 and below stake nothing."""
    b = decimal - 1
    lose = 1 - p - (push if push is not None else F.lit(0.0))
    return F.when(b > 0, F.greatest(F.lit(0.0), (p * b - lose) / b)).otherwise(F.lit(0.0))


def margin_grid(df: DataFrame, key: list[str], mean: str, sd: float, low: int, high: int) -> DataFrame:
    """Normalised probabilities of whole margins low to high from a normal curve, one row per margin."""
    g = df.select(*key, F.col(mean).alias("_m"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("margin"))
    p = normal_cdf((F.col("margin") + 0.5 - F.col("_m")) / sd) - normal_cdf((F.col("margin") - 0.5 - F.col("_m")) / sd)
    whole = normal_cdf((F.lit(high) + 0.5 - F.col("_m")) / sd) - normal_cdf((F.lit(low) - 0.5 - F.col("_m")) / sd)
    return g.withColumn("p", F.try_divide(p, whole)).drop("_m")


def folded_grid(df: DataFrame, key: list[str], mean: str, sd: float, low: int = -75, high: int = 75) -> DataFrame:
    """As margin_grid, but what lies beyond either end counts to that end's margin, so nothing is scaled."""
    g = df.select(*key, F.col(mean).alias("_m"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("margin"))
    up = F.when(F.col("margin") == high, F.lit(1.0)).otherwise(normal_cdf((F.col("margin") + 0.5 - F.col("_m")) / sd))
    down = F.when(F.col("margin") == low, F.lit(0.0)).otherwise(normal_cdf((F.col("margin") - 0.5 - F.col("_m")) / sd))
    return g.withColumn("p", up - down).drop("_m")


def nearest_center(df: DataFrame, value: str, centers: DataFrame, center: str) -> DataFrame:
    """df with the center nearest to its value, the lower of two equally near ones; null without a value.

    Centers are a registered table of a few hundred rows; a sorted array of them goes along with every row.
    """
    all_ = centers.where(F.col(center).isNotNull()).agg(F.array_sort(F.collect_set(F.col(center).cast("double"))).alias("_c"))
    gap = lambda c: F.struct(F.abs(c - F.col(value)).alias("gap"), c.alias("c"))
    near = F.array_min(F.transform("_c", gap))["c"]
    return df.join(F.broadcast(all_)).withColumn(center, F.when(F.col(value).isNotNull(), near)).drop("_c")  # one row


def decision(edge: Column, fresh: Column, least_edge: float) -> Column:
    """ABSTAIN without an edge or fresh prices, BET from `least_edge` on, else NO_BET."""
    return F.when(edge.isNull() | ~F.coalesce(fresh, F.lit(False)), "ABSTAIN").when(edge >= least_edge, "BET").otherwise("NO_BET")


def regions(df: DataFrame, edge: Column, sd: float, line: str) -> DataFrame:
    """df with win, push and loss as three_regions gives them, from two points of the curve that a row has once."""
    whole = F.abs(F.col(line) - F.round(line)) <= 1e-8
    z = df.withColumns({"_whole": whole, "_edge": edge})
    z = z.withColumns({"_up": F.when(F.col("_whole"), (0.5 - F.col("_edge")) / sd).otherwise(F.col("_edge") / sd), "_down": (-0.5 - F.col("_edge")) / sd})
    p = z.withColumns({"_above": normal_cdf("_up"), "_below": normal_cdf("_down")})
    a, b = F.col("_above"), F.col("_below")
    out = {"win": F.when(F.col("_whole"), 1 - a).otherwise(a), "push": F.when(F.col("_whole"), a - b).otherwise(0.0), "loss": F.when(F.col("_whole"), b).otherwise(1 - a)}
    return p.withColumns(out).drop("_whole", "_edge", "_up", "_down", "_above", "_below")


def ladder(df: DataFrame, key: list[str], mean: str, line: str, sd: float, steps: int = 14, step: float = 1.0, hold: float = 0.045) -> DataFrame:
    """Rungs around a line: rung, win, push, loss and the price offered under a hold (null where a win is rarer than 1%)."""
    g = df.select(*key, F.col(mean).alias("_m"), F.col(line).alias("_l")).repartition(*key)  # a small file is one task, and each row becomes many
    g = g.withColumn("_k", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).select(*key, "_m", (F.col("_l") + F.col("_k") * step).alias("rung"))
    return regions(g, F.col("_m") + F.col("rung"), sd, "rung").withColumn("offered", F.when(F.col("win") > 0.01, offered_decimal(F.col("win"), F.col("loss"), hold))).drop("_m")


def covers(grid: DataFrame, key: list[str], margin: str, p: str, line: Column) -> DataFrame:
    """cover, push and fail of a line from margin probabilities, normalised."""
    edge = F.col(margin) + line
    s = grid.groupBy(*key).agg(*[F.sum(F.when(c, F.col(p)).otherwise(0.0)).alias(n) for n, c in (("cover", edge > 0), ("push", edge == 0), ("fail", edge < 0))])
    total = F.col("cover") + F.col("push") + F.col("fail")
    return s.select(*key, *[F.try_divide(F.col(c), total).alias(c) for c in ("cover", "push", "fail")])


def shrunk_grid(df: DataFrame, bucket: str, margin: str, sd: float, low: int, high: int, strength: float = 200.0) -> DataFrame:
    """Per bucket and whole margin: the share of rows, shrunk n / (n + strength) towards a centred normal curve."""
    h = df.where(F.col(margin).between(low, high)).groupBy(bucket, margin).agg(F.count("*").alias("_k"))
    n = h.groupBy(bucket).agg(F.sum("_k").alias("n"))
    g = folded_grid(n.withColumn("_zero", F.lit(0.0)), [bucket, "n"], "_zero", sd, low, high).withColumnRenamed("p", "_curve")
    j = g.join(h.withColumnRenamed(margin, "margin"), [bucket, "margin"], "left")
    return j.select(bucket, "margin", ((F.coalesce("_k", F.lit(0)) + strength * F.col("_curve")) / (F.col("n") + strength)).alias("p"))


def card(games: DataFrame, key: list[str], margin_sd: float, total_sd: float, readiness: dict[str, str], decimal: float = 1 + 100 / 110) -> DataFrame:
    """One row per game and market (moneyline, ats, total), from one pass over the games.

    games: key, home_team, away_team, home_spread, total_line. win, push and other are the line's own probabilities of the
    home side (over): they sum to one, and are null without a line. A moneyline's tie stands in tie and is no push.
    Optional columns: market_<market> and model_<market> (null: the win, and the market's probability), odds_<market>
    (null: `decimal`). stake is full Kelly. A market that `readiness` lacks is RETAIN_BASELINE.
    """
    spread, total = number("home_spread"), number("total_line")
    given = lambda name: number(name) if name in games.columns else F.lit(None).cast("double")
    level = lambda line: F.when(line.isNotNull(), 0.0)  # noqa: E731  the mean lies on the line
    rows = []
    for market, at, edge, sd, line in (("moneyline", spread, -spread, margin_sd, level(spread)), ("ats", spread, level(spread), margin_sd, spread), ("total", total, level(total), total_sd, total)):
        named = {"market": F.lit(market), "readiness": F.lit(readiness.get(market, "RETAIN_BASELINE")), "line": at, "_edge": edge, "_sd": F.lit(float(sd)), "_line": line}
        named |= {"fair": given(f"market_{market}"), "model": given(f"model_{market}"), "odds": F.coalesce(given(f"odds_{market}"), F.lit(decimal))}
        rows.append(F.struct(*[c.alias(n) for n, c in named.items()]))
    matchup = F.concat_ws(" @ ", "away_team", "home_team").alias("matchup")
    tie = three_regions(-spread, margin_sd, level(spread))[1]
    c = games.select(*key, matchup, (-spread).alias("home_margin"), F.when(spread.isNotNull(), tie).alias("tie"), F.explode(F.array(*rows)).alias("m")).select(*key, "matchup", "home_margin", "tie", "m.*")
    win, push, other = three_regions(F.col("_edge"), F.col("_sd"), F.col("_line"))
    push = F.when(F.col("market") == "moneyline", 0.0).otherwise(push)
    c = c.withColumns({n: F.when(F.col("_line").isNotNull(), p) for n, p in (("win", win), ("push", push), ("other", other))}).drop("_edge", "_sd", "_line")
    c = c.withColumn("fair", F.coalesce("fair", "win")).withColumn("model", F.coalesce("model", "fair"))
    stake = kelly(F.col("model"), F.col("odds"), F.col("push"))
    return c.withColumns({"edge": F.col("model") - F.col("fair"), "stake": F.coalesce(stake, F.lit(0.0))})
