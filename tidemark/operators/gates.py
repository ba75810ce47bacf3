"""Checks that tell how many rows break a rule, gates on schemas, and decisions by stated limits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_column(df: DataFrame, names: Sequence[str], default=...) -> Column:
    """The first of the columns that df has, else the default (raises without one)."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    if default is ...:
        raise ValueError(f"none of {list(names)} is there")
    return F.lit(default)


def distinct_columns(*lists: Sequence[str]) -> list[str]:
    """All names once, in the order of their first appearance."""
    return list(dict.fromkeys(n for some in lists for n in some))


def allowed_columns(names: Sequence[str], banned: Sequence[str] = (), patterns: Sequence[str] = ()) -> list[str]:
    """The names, if none is banned or matches a pattern; raises with those that are."""
    bad = [n for n in names if n in set(banned) or any(re.search(p, n) for p in patterns)]
    if bad:
        raise ValueError(f"banned columns: {bad}")
    return list(names)


def one_role_each(names: Sequence[str], roles: dict[str, Sequence[str]], like: str, blocked: Sequence[str]) -> list[str]:
    """Columns that may be used: each name that matches `like` must have exactly one role, and not a blocked one."""
    held = {n: [r for r, some in roles.items() if n in some] for n in names if re.search(like, n)}
    wrong = {n: r for n, r in held.items() if len(r) != 1}
    if wrong:
        raise ValueError(f"columns need one role each: {wrong}")
    return [n for n in names if not set(held.get(n, ())) & set(blocked)]


def feature_matrix(df: DataFrame, meta: Sequence[str], target: str, features: Sequence[str], most_missing: float = 1.0) -> DataFrame:
    """meta, target and features; raises for features without values, with one value only, or missing too often."""
    checks = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"k_{i}") for i, c in enumerate(features)], *[F.min(c).eqNullSafe(F.max(c)).alias(f"s_{i}") for i, c in enumerate(features)]).first()
    n = checks["n"]
    bad = [c for i, c in enumerate(features) if n and (not checks[f"k_{i}"] or checks[f"s_{i}"] or 1 - checks[f"k_{i}"] / n > most_missing)]
    if bad:
        raise ValueError(f"features without information: {bad}")
    return df.select(*distinct_columns(meta, [target], features))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule (a condition that holds is kept; null breaks it). One aggregate."""
    kept = lambda c: F.coalesce(c, F.lit(False))
    row = df.agg(*[F.count_if(~kept(c)).alias(n) for n, c in rules.items()])
    return row.unpivot([], list(rules), "rule", "n")


def identity_rules(win: str, push: str, other: str, line: str, near: float = 1e-4) -> dict[str, Column]:
    """Rules for three independent probabilities: each in [0, 1], together 1, and no push on a line that is not whole."""
    p = [F.col(c) for c in (win, push, other)]
    half = F.abs(F.col(line) - F.round(line)) > 1e-8
    return {f"{c}_in_range": F.col(c).between(0, 1) for c in (win, push, other)} | {"sum_is_one": F.abs(p[0] + p[1] + p[2] - 1) <= near, "no_push_on_half": ~half | (F.abs(p[1]) <= 1e-9)}


def odds_rules(decimal: str, american: str, near: float = 1e-6) -> dict[str, Column]:
    """Rules for prices: decimal odds over 1 and the same as the American ones."""
    a = F.col(american)
    as_decimal = F.when(a > 0, 1 + a / 100).when(a < 0, 1 - 100 / a)
    return {"decimal_over_one": F.col(decimal) > 1, "prices_agree": F.abs(F.col(decimal) - as_decimal) <= near}


def off_sums(df: DataFrame, key: Sequence[str], p: str, near: float = 1e-6) -> DataFrame:
    """Keys whose shares do not add up to 1."""
    return df.groupBy(*key).agg(F.coalesce(F.sum(p), F.lit(0.0)).alias("total")).where(F.abs(F.col("total") - 1) > near)


def mismatches(own: DataFrame, again: DataFrame, key: Sequence[str], columns: Sequence[str], near: float = 1e-9) -> DataFrame:
    """(key, column) of values that differ from those computed again; two nulls or NaNs are equal."""
    b = again.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    gap = lambda c: ~(F.col(c).eqNullSafe(F.col(f"_{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= near, F.lit(False)))
    wrong = own.join(b, list(key)).withColumn("column", F.explode(F.array_compact(F.array(*[F.when(gap(c), c) for c in columns]))))
    return wrong.select(*key, "column")


def available_after(df: DataFrame, kickoff: str, hours: float, name: str = "available_at") -> DataFrame:
    """Adds when a game's outcome may be used: so many hours after its start."""
    return df.withColumn(name, F.col(kickoff) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours * 3600))))


#: Statuses of a game that is over, and of one that is not.
FINAL = ("FINAL", "COMPLETED", "CLOSED", "FINAL_OT", "F")
OPEN = ("IN_PROGRESS", "INPROGRESS", "LIVE", "HALFTIME", "DELAYED", "SCHEDULED", "PREGAME", "SUSPENDED", "POSTPONED")


def finality(games: DataFrame, as_of: Column, kickoff: str, status: str, completed: str, last_play: str, replay: bool = False, hours: float = 5.0) -> DataFrame:
    """Adds verified, assumed, finality and reason: whether a game was known to be over at a time.

    Only evidence from before that time verifies: a time of completion, or of the last play where there is none. In a
    replay a game without evidence is assumed to be available `hours` after its start; that never counts as verified.
    """
    ko, done, last = F.col(kickoff), F.col(completed), F.col(last_play)
    s = F.upper(F.trim(F.col(status)))
    later, open_ = F.coalesce(ko > as_of, F.lit(False)), F.coalesce(s.isin(*OPEN), F.lit(False))
    state = (
        F.when(later, "POST_ASOF_KICKOFF").when(open_, "EXPLICIT_NON_FINAL").when(done <= as_of, "FINAL_BEFORE_ASOF").when(done > as_of, "IN_PROGRESS_AT_ASOF").when(last <= as_of, "FINAL_BEFORE_ASOF").otherwise("UNKNOWN_FINALITY")
    )
    out = games.withColumn("finality", state).withColumn("verified", F.col("finality") == "FINAL_BEFORE_ASOF")
    policy = F.coalesce(ko + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours * 3600))) <= as_of, F.lit(False)) if replay else F.lit(False)
    out = out.withColumn("assumed", ~F.col("verified") & policy)
    reason = F.when(F.col("verified"), "").when(later, "kickoff_after_asof").when(open_, F.concat(F.lit("status="), s)).when(F.col("finality") == "IN_PROGRESS_AT_ASOF", "completion_after_asof").otherwise("no_finality_evidence")
    out = out.withColumn("reason", reason)
    return out.withColumn("finality", F.when(F.col("assumed") & (F.col("finality") == "UNKNOWN_FINALITY"), "HISTORICAL_AVAILABILITY_ASSUMPTION").otherwise(F.col("finality")))


def promotion(df: DataFrame, weeks: str, gain: str, low: str, drift: str, least_weeks: int = 4, breakeven: float = 0.524) -> DataFrame:
    """Adds decision and reason: an alarm demotes, all gates promote, else the gates that are missing hold it."""
    ok = [(F.col(weeks) >= least_weeks, f"weeks<{least_weeks}"), (F.col(gain) > 0, "log_loss_gain<=0"), (F.col(low) > breakeven, f"pick_acc_ci_lower<={breakeven}")]
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), t) for c, t in ok])), ";")
    alarm = F.coalesce(F.col(drift), F.lit(False))
    decision = F.when(alarm, "DEMOTE_TO_RETAIN_BASELINE").when(missing == "", "PROMOTE_TO_LIVE_STAKE").otherwise("HOLD_PROVISIONAL_STAKE_ZERO")
    return df.withColumns({"decision": decision, "reason": F.when(alarm, "DRIFT_ALARM").when(missing == "", "LIVE_GATE_PASSED").otherwise(missing)})


def reliability(df: DataFrame, valid: str, n: str, ece: str, slope: str, intercept: str, gap_low: str, gap: str, stable: str, least_n: int = 100, most_ece: float = 0.05, slopes: tuple[float, float] = (0.8, 1.2), intercepts: tuple[float, float] = (-0.1, 0.1), margin: float = 0.02) -> DataFrame:
    """Adds status by stated limits; a diagnostic that is null can't be estimated."""
    f = F.col
    known = f(ece).isNotNull() & f(slope).isNotNull() & f(intercept).isNotNull()
    worry = (f(ece) > most_ece) | ~f(slope).between(*slopes) | ~f(intercept).between(*intercepts) | F.coalesce(f(gap_low) > margin, F.lit(False)) | ~f(stable) | F.coalesce(f(gap) > margin, F.lit(False))
    status = F.when(~f(valid), "WITHHOLD_SHADOW_OUTPUT").when((f(n) < least_n) | ~known, "INCONCLUSIVE_SMALL_SAMPLE").when(worry, "CALIBRATION_CONCERN").otherwise("SUPPORTED_FOR_SHADOW_MONITORING")
    return df.withColumn("status", status)


def modal(df: DataFrame, value: str) -> DataFrame:
    """The most frequent value, the greatest of equally frequent ones; one row, none if there are no values."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return c.agg(F.max(F.struct("n", value)).alias("b")).where("b IS NOT NULL").select(f"b.{value}", "b.n")


def with_fallback(df: DataFrame, priors: DataFrame, key: str, mean: str, sd: str, weight: str, widen: float = 2.0, no_mean: float = 0.0, no_sd: float = 0.2) -> DataFrame:
    """df's keys with their priors; those without one get the weighted mean of all and the median deviation, widened."""
    league = priors.agg(F.coalesce(F.try_divide(F.sum(F.col(mean) * F.greatest(F.col(weight), F.lit(1e-9))), F.sum(F.greatest(F.col(weight), F.lit(1e-9)))), F.lit(no_mean)).alias("_m"), F.coalesce(F.percentile(sd, F.lit(0.5)), F.lit(no_sd)).alias("_s"))
    j = df.join(priors.select(key, mean, sd, F.lit(True).alias("_own")), key, "left").join(F.broadcast(league))  # one row
    own = F.coalesce("_own", F.lit(False))
    return j.withColumns({mean: F.when(own, F.col(mean)).otherwise(F.col("_m")), sd: F.when(own, F.col(sd)).otherwise(F.col("_s") * widen), "origin": F.when(own, "prior").otherwise("fallback")}).drop("_m", "_s", "_own")


def continuity(before: DataFrame, now: DataFrame, team: str, player: str, group: str, amounts: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Per team the share of last season's amounts by players who are still there: all, and the first two by group."""
    stay = now.select(team, player).distinct().withColumn("_stays", F.lit(True))
    j = before.join(stay, [team, player], "left")
    share = lambda x, on=F.lit(True): F.try_divide(F.coalesce(F.sum(F.when(on & F.col("_stays"), x)), F.lit(0.0)), F.nullif(F.sum(F.when(on, x)), F.lit(0.0)))
    both = F.coalesce(F.col(amounts[0]), F.lit(0.0)) + F.coalesce(F.col(amounts[1]), F.lit(0.0))
    return j.groupBy(team).agg(*[share(F.coalesce(F.col(a), F.lit(0.0))).alias(f"returning_{a}") for a in amounts], *[share(both, F.col(group) == g).alias(f"returning_{g.lower()}") for g in groups])


def first_seen(df: DataFrame, key: Sequence[str], season: str, name: str) -> DataFrame:
    """Adds the first season of the key."""
    return df.withColumn(name, F.min(season).over(Window.partitionBy(*key)))
