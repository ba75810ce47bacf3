"""Calibration of three-way probabilities season by season, each from earlier seasons only, all seasons in one job a step.

A season's fold is a logistic curve on the logit of the conditional probability, and scales of the push probability by
bucket. A row of season s serves every later fold of its group, so a Newton step is one aggregate over rows joined with
the folds' weights, whatever the number of groups and seasons; two by two systems are solved as columns. Push counts
are running sums over seasons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.prices import push_bucket
from tidemark.operators.prefix import sums_before
from tidemark.operators.stages import staged

EPSILON = 1e-6


def _clip(c: Column, low: float = EPSILON, high: float = 1 - EPSILON) -> Column:
    # greatest passes nulls over, so they are kept apart
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def _logit(c: Column) -> Column:
    return F.log(_clip(c)) - F.log(1 - _clip(c))


def expanding_curves(rows: DataFrame, group: Sequence[str], season: str, x: str, y: str, penalty: float, least: int = 100, rounds: int = 30) -> DataFrame:
    """(group, season, intercept, slope, n): for every season of a group the curve fitted to its earlier seasons.

    rows: x may be anything finite, y 0 or 1; other rows count for nothing. The slope bears the ridge penalty, the intercept
    none. A season with fewer than `least` earlier rows, or of one outcome, has nulls. Each round is one job for all folds.
    """
    g = rows.select(*group, F.col(season).alias("season"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    good = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")) & F.col("y").isin(0.0, 1.0)
    folds = staged(g.select(*group, "season").distinct(), "folds")
    g = staged(g.where(good), "curve-rows")
    n = sums_before(folds, g, group, "season", "season", {"n": F.count("*"), "up": F.sum("y")}, width=16)
    fits = (F.col("n") >= least) & (F.col("up") > 0) & (F.col("up") < F.col("n"))
    state = staged(n.select(*group, F.col("season").alias("fold"), F.col("n").cast("long").alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), fits.alias("fits"), F.lit(1.0).alias("moved")), "curves")
    few = state.count() <= 100_000  # of some 60 bytes; rows then stay where they are, however they are spread over groups
    for _ in range(rounds):
        open_ = state.where("fits AND moved > 1e-11")
        if open_.isEmpty():
            break
        t = g.join(F.broadcast(open_) if few else open_, [*group]).where("season < fold")
        p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        t = t.withColumn("_e", F.col("y") - p).withColumn("_v", p * (1 - p))
        s = t.groupBy(*group, "fold", "n", "a", "b").agg(F.sum("_e").alias("ga"), F.sum(F.col("_e") * F.col("x")).alias("gx"), F.sum("_v").alias("haa"), F.sum(F.col("_v") * F.col("x")).alias("hab"), F.sum(F.col("_v") * F.col("x") * F.col("x")).alias("hxx"))
        gb, hbb = F.col("gx") - penalty * F.col("b"), F.col("hxx") + penalty
        det = F.col("haa") * hbb - F.col("hab") * F.col("hab")
        da, db = (hbb * F.col("ga") - F.col("hab") * gb) / det, (F.col("haa") * gb - F.col("hab") * F.col("ga")) / det
        moved = s.select(*group, "fold", "n", (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), F.lit(True).alias("fits"), F.greatest(F.abs(da), F.abs(db)).alias("moved"))
        state = staged(moved.unionByName(state.where("NOT (fits AND moved > 1e-11)")), "curves")
    keep = lambda c: F.when(F.col("fits"), F.col(c))
    return state.select(*group, F.col("fold").alias("season"), keep("a").alias("intercept"), keep("b").alias("slope"), "n")


def push_scales(rows: DataFrame, group: Sequence[str], season: str, bucket: str, raw: str, push: str, strength: float) -> DataFrame:
    """(group, season, bucket, scale, rows): what raw push probabilities of a season and bucket are multiplied by.

    A bucket's rate over earlier seasons is shrunk by `strength` rows to the group's; over its mean raw probability it is
    the scale. A bucket that earlier seasons lack has the group's scale, NO_PUSH has 0; rows 0 means no earlier season.
    """
    r = rows.select(*group, F.col(season).alias("season"), F.col(bucket).alias("bucket"), _clip(F.nanvl(F.coalesce(F.col(raw).cast("double"), F.lit(0.0)), F.lit(0.0)), 0.0, 1.0).alias("raw"), F.coalesce(F.col(push).cast("double"), F.lit(0.0)).alias("push"))
    r = staged(r.groupBy(*group, "season", "bucket").agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), F.sum("push").alias("push")), "push-counts")
    sums = {"n": F.sum("n"), "raw": F.sum("raw"), "push": F.sum("push")}
    whole = sums_before(r.select(*group, "season").distinct(), r, group, "season", "season", {f"g_{k}": v for k, v in sums.items()}, width=16)
    mine = sums_before(r.select(*group, "bucket", "season"), r, [*group, "bucket"], "season", "season", sums, width=16)
    j = mine.join(whole, [*group, "season"])
    rate = (F.col("g_push") + 0.5) / (F.col("g_n") + 1)
    mean = lambda total, n: F.greatest(F.try_divide(F.col(total), F.col(n)), F.lit(EPSILON))
    own = (F.col("push") + strength * rate) / (F.col("n") + strength) / mean("raw", "n")
    scale = F.when(F.col("bucket") == "NO_PUSH", 0.0).when(F.col("n") > 0, own).otherwise(rate / mean("g_raw", "g_n"))
    return j.select(*group, "season", "bucket", scale.alias("scale"), F.col("g_n").cast("long").alias("rows"))


def three_way(rows: DataFrame, group: Sequence[str], *, market: str, season: str, line: str, conditional: str, raw_push: str, scored: str, target: str, push: str, status: str | None = None, c: float = 0.2, strength: float = 40.0, most_push: float = 0.25) -> DataFrame:
    """rows with calibrated_lower, calibrated_push, calibrated_upper, calibrated_conditional and calibration_method.

    market is one of moneyline, spread, total (push_bucket); `scored` rows have the 0/1 target that curves are fitted to. A group
    whose status starts with RETAIN_BASELINE keeps its probabilities, as does a first season; both are only put
    together into three that add to 1.
    """
    given = rows.withColumn("_bucket", push_bucket(F.col(market), F.col(line).cast("double")))
    p, q = F.col(conditional).cast("double"), F.nanvl(F.coalesce(F.col(raw_push).cast("double"), F.lit(0.0)), F.lit(0.0))
    train = given.where(F.coalesce(F.col(scored).cast("boolean"), F.lit(False))).withColumn("_x", _logit(F.nanvl(p, F.lit(None).cast("double"))))
    folds = given.select(*group, season).distinct()  # a season may have no scored row of its own
    curves = expanding_curves(train.select(*group, season, "_x", target).unionByName(folds.withColumn("_x", F.lit(None).cast("double")).withColumn(target, F.lit(None).cast(given.schema[target].dataType))), group, season, "_x", target, 1 / c)
    scales = push_scales(given, group, season, "_bucket", raw_push, push, strength)
    j = given.join(curves.select(*group, F.col("season").alias(season), "intercept", "slope"), [*group, season]).join(scales.select(*group, F.col("season").alias(season), F.col("bucket").alias("_bucket"), "scale", F.col("rows").alias("_rows")), [*group, season, "_bucket"])
    kept = F.coalesce(F.col(status).startswith("RETAIN_BASELINE"), F.lit(False)) if status else F.lit(False)
    same = kept | (F.col("_rows") == 0)
    curve = _clip(1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * _logit(p)))))
    up = _clip(F.when(same, p).otherwise(F.when(F.col("intercept").isNull(), _clip(p)).otherwise(curve)), 0.0, 1.0)
    out = _clip(F.when(same, q).otherwise(_clip(_clip(q, 0.0, 1.0) * F.col("scale"), 0.0, most_push)), 0.0, 1.0)
    method = F.when(kept, "baseline_retained_no_calibration").when(F.col("_rows") == 0, "identity_no_prior_oof").otherwise("expanding_prior_seasons_only")
    j = j.withColumns({"_up": up, "_push": out, "calibration_method": method})
    j = j.withColumns({"calibrated_lower": (1 - F.col("_push")) * (1 - F.col("_up")), "calibrated_push": F.col("_push"), "calibrated_upper": (1 - F.col("_push")) * F.col("_up")})
    both = F.col("calibrated_lower") + F.col("calibrated_upper")
    j = j.withColumn("calibrated_conditional", F.when(both > 0, F.col("calibrated_upper") / both).when(both.isNotNull(), 0.5))
    return j.drop("_bucket", "_rows", "_up", "_push", "intercept", "slope", "scale")
