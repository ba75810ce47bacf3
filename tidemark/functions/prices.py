"""Column expressions for two-way prices, ratings and game state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_cdf

HALVINGS = 60


def power_devig(p: Column, q: Column) -> Column:
    """p ** k where p ** k + q ** k = 1, k by bisection inside the expression; shares of the sum where there is no margin.

    Null where a price is null or outside (0, 1).
    """
    state = F.struct(F.lit(1.0).alias("low"), F.lit(64.0).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        over = F.pow(p, mid) + F.pow(q, mid) > 1
        return F.struct(F.when(over, mid).otherwise(s["low"]).alias("low"), F.when(over, s["high"]).otherwise(mid).alias("high"))

    k = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), state, halve, lambda s: (s["low"] + s["high"]) / 2)
    return F.when((p > 0) & (p < 1) & (q > 0) & (q < 1), F.when(p + q <= 1, p / (p + q)).otherwise(F.pow(p, k)))


def shin_devig(p: Column, q: Column) -> Column:
    """Fair probability of the first of two sides with a share z of insiders, which two sides give in closed form."""
    s, d = p + q, p - q
    z = (s - 1) * (d * d - s) / (s * (d * d - 1))
    fair = (F.sqrt(z * z + 4 * (1 - z) * p * p / s) - z) / (2 * (1 - z))
    return F.when((p > 0) & (p < 1) & (q > 0) & (q < 1), F.when(s <= 1, p / s).otherwise(fair))


def three_regions(edge: Column, sd: Column | float, line: Column) -> tuple[Column, Column, Column]:
    """(win, push, loss) under a normal margin: only whole lines can push, half a point to both sides."""
    whole = F.abs(line - F.round(line)) <= 1e-8
    above, below = normal_cdf((0.5 - edge) / sd), normal_cdf((-0.5 - edge) / sd)
    win = F.when(whole, 1 - above).otherwise(normal_cdf(edge / sd))
    push = F.when(whole, above - below).otherwise(0.0)
    return win, push, F.when(whole, below).otherwise(1 - normal_cdf(edge / sd))


def divergence(p: Column, q: Column, eps: float = 1e-9) -> Column:
    """Kullback-Leibler divergence of two-way probabilities, in nats."""
    a, b = (F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps)) for x in (p, q))
    return a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b))


def penalized_edge(p: Column, q: Column) -> Column:
    return p - q - divergence(p, q) / 2


def contest_points(p: Column, y: Column, week: Column) -> Column:
    """25 less 100 squared errors, half-up to one decimal, twice that after week 17."""
    points = F.round((25 - 100 * (p - y) ** 2).cast("decimal(18,9)"), 1).cast("double")
    return F.when(week > 17, points * 2).otherwise(points)


def elo_chance(gap: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -gap / scale))


def margin_multiplier(margin: Column, winner_gap: Column) -> Column:
    """Null for negative margins and where the denominator is not positive."""
    below = winner_gap * 0.001 + 2.2
    return F.when((margin >= 0) & (below > 0), F.log(margin + 1) * 2.2 / below)


def competitive(seconds: Column, margin: Column) -> Column:
    """Whether a margin still leaves the outcome open; nulls count as zero."""
    t, m = F.coalesce(seconds, F.lit(0)), F.abs(F.coalesce(margin, F.lit(0)))
    return m <= F.when(t > 1800, 24).when(t > 900, 20).when(t > 300, 16).otherwise(8)


def experience(years: Column) -> Column:
    return F.when(years.isNull(), "unknown").when(years <= 0, "rookie").when(years <= 2, "years_1_2").when(years <= 5, "years_3_5").when(years <= 9, "years_6_9").otherwise("years_10_plus")


def push_bucket(market: Column, line: Column) -> Column:
    """What push rates are pooled by: nothing for moneylines, the whole line (its size for spreads)."""
    whole = F.abs(line - F.round(line)) <= 1e-9
    number = F.when(market == "spread", F.abs(line)).otherwise(line)
    return F.when(market == "moneyline", "GLOBAL").when(line.isNull() | F.isnan(line), "MISSING").when(~whole, "NO_PUSH").otherwise(F.concat(F.lit("INT_"), F.round(number).cast("long").cast("string")))


def fair_decimal(win: Column, push: Column) -> Column:
    return (1 - push) / F.greatest(win, F.lit(1e-9))


def offered_decimal(win: Column, other: Column, hold: float) -> Column:
    return 1 / F.least(F.try_divide(win, win + other) * (1 + hold), F.lit(1 - 1e-9))
