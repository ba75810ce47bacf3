"""What is known of every entity before a snapshot day: faded, exposure-capped means shrunk to their group's, and mixtures.

A game counts towards an entity's mean by its exposure, halved for every `half_life` of exposure that came after it, and
only while less than `cap` of exposure came after it; the one that passes the cap counts in part. Seasons fade by
`decay` and those older than `seasons` don't count. Every game keeps the faded sums through it, so what counts at a
snapshot is the difference of two rows of each entity, however many days or games there are: no day is joined with all
days before it. The sums over all entities are running sums of what each game changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import DAY, fading_sums, last_before, running
from tidemark.operators.stages import staged

_SUMS = ("w", "wv", "wvv")
_KEY = ["metric", "kind", "entity"]


@dataclass(frozen=True)
class Metric:
    """A metric with its exposure, its prior before anything is known, and the bounds of its means."""

    name: str
    exposure: str
    mean: float
    sd: float
    strength: float = 250.0
    least_sd: float = 0.02
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Fading:
    half_life: float = 400.0
    cap: float = 1000.0
    seasons: int = 3
    decay: float = 0.6


def _of(metrics: Sequence[Metric], field: str) -> Column:
    """The metric's own number, by the column `metric`; null where it has none."""
    named = [x for m in metrics if getattr(m, field) is not None for x in (F.lit(m.name), F.lit(float(getattr(m, field))))]
    return F.try_element_at(F.create_map(*named), F.col("metric")) if named else F.lit(None).cast("double")


def _bounded(c: Column, metrics: Sequence[Metric]) -> Column:
    # greatest and least pass nulls over, so a metric without a bound keeps its value
    return F.when(c.isNotNull(), F.least(F.greatest(c, _of(metrics, "low")), _of(metrics, "high")))


def long_history(games: DataFrame, metrics: Sequence[Metric], kinds: Sequence[str], day: str, season: str, order: Sequence[str]) -> DataFrame:
    """A row per game, metric and kind of entity: metric, kind, entity, day, season, at (the order), value, exposure.

    kinds: the columns that name entities (a player, a team). Rows with a null entity, day, season, value or exposure,
    with NaN, or without exposure are left out.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    cells = F.array(*[F.struct(F.lit(m.name).alias("metric"), number(m.name).alias("value"), number(m.exposure).alias("exposure")) for m in metrics])
    who = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("entity")) for k in kinds])
    rows = games.select(F.col(day).alias("day"), F.col(season).cast("int").alias("season"), F.struct(*order).alias("at"), F.explode(cells).alias("c"), who.alias("who"))
    rows = rows.select("day", "season", "at", "c.*", F.explode("who").alias("k")).select("metric", "k.kind", "k.entity", "day", "season", "at", "value", "exposure")
    return rows.dropna().where("exposure > 0")


def _ledger(history: DataFrame, f: Fading) -> DataFrame:
    """A row per game of history and one at x 0 before an entity's first: day, at, x and `pack`.

    x is the exposure through the game; pack holds x, season, the sums faded to the game, and the game that comes next.
    """
    at = [*_KEY, "season"]
    h = running(history, _KEY, ["at"], ["exposure"], F.col("season"), inclusive=True).withColumnRenamed("before_exposure", "x")
    h = h.withColumns({"fade": F.col("x") / f.half_life + F.col("season") * log2(1 / f.decay), "w": F.col("exposure"), "wv": F.col("exposure") * F.col("value"), "wvv": F.col("exposure") * F.col("value") ** 2})
    h = staged(fading_sums(staged(h, "exposures"), _KEY, ["at"], "fade", _SUMS), "faded")
    game = F.struct("x", "value", "season")
    firsts = h.groupBy(*at).agg(F.min_by(game, "at").alias("first"))
    w = Window.partitionBy(*_KEY).orderBy("season")  # a row per season
    firsts = firsts.withColumn("after", F.lead("first").over(w)).withColumn("n", F.row_number().over(w))
    h = h.withColumn("own", F.lead(game).over(Window.partitionBy(*at).orderBy("at"))).join(firsts.select(*at, "after"), at)
    rows = h.select(*_KEY, "season", "day", "at", "x", F.struct("x", "season", *[F.col(f"faded_{c}").alias(c) for c in _SUMS], F.coalesce("own", "after").alias("next")).alias("pack"))
    kind = {c: h.schema[c].dataType for c in ("day", "at", "season")}
    null = [F.lit(None).cast(kind[c]).alias(c) for c in ("season", "day", "at")]
    start = F.struct(F.lit(0.0).alias("x"), F.lit(None).cast("int").alias("season"), *[F.lit(0.0).alias(c) for c in _SUMS], F.col("first").alias("next"))
    return staged(rows.unionByName(firsts.where("n = 1").select(*_KEY, *null, F.lit(0.0).alias("x"), start.alias("pack"))), "ledger")


def _day_ends(ledger: DataFrame) -> DataFrame:
    """Every entity's last game of a day: x and pack. Snapshots are of days, so nothing else is read as a state."""
    games = ledger.where("season IS NOT NULL")
    return staged(games.groupBy(*_KEY, "season", "day").agg(F.max("x").alias("x"), F.max_by("pack", "x").alias("pack")), "day-ends")


def _read(points: DataFrame, ledger: DataFrame, days: DataFrame, f: Fading) -> DataFrame:
    """points (metric, kind, entity, season, pack: the last game that is known) with w, wv, wvv of the games that count in that season."""
    points = staged(points.withColumn("_floor", F.col("pack.x") - f.cap).withColumn("_old", F.col("season") - f.seasons), "points")
    p = staged(last_before(points, ledger, _KEY, "_floor", "x", {"_capped": "pack"}, width=f.cap), "capped")
    closing = days.groupBy(*_KEY, "season").agg(F.max_by("pack", "x").alias("pack"))
    p = last_before(p, closing, _KEY, "_old", "season", {"_aged": "pack"}, width=16)
    p = p.withColumn("_j", F.when(F.coalesce(F.col("_aged.x") > F.col("_capped.x"), F.col("_capped").isNull()), F.col("_aged")).otherwise(F.col("_capped")))
    half = lambda gap: F.pow(F.lit(2.0), -gap / f.half_life)
    fade = lambda season: F.pow(F.lit(f.decay), F.col("season") - season)
    x, jx = F.col("pack.x"), F.coalesce("_j.x", F.lit(0.0))
    # the game at the cap counts up to it: what it has beyond is taken off
    over = F.greatest(F.lit(0.0), x - f.cap - jx) * half(x - F.col("_j.next.x")) * fade(F.col("_j.next.season"))
    out = {}
    for power, c in enumerate(_SUMS):
        early = F.coalesce(half(x - jx) * fade(F.col("_j.season")) * F.col(f"_j.{c}"), F.lit(0.0))
        extra = F.coalesce(over * F.pow(F.col("_j.next.value"), F.lit(power)), F.lit(0.0))
        out[c] = F.when(jx < x, fade(F.col("pack.season")) * F.col(f"pack.{c}") - early - extra).otherwise(0.0)
    return p.withColumns(out).drop("_floor", "_old", "_capped", "_aged", "_j")


def _group_points(days: DataFrame, f: Fading) -> DataFrame:
    """The states that _group_sums takes the changes of: every day's end (own 1), and the start of every season (own 0)."""
    points = days.select(*_KEY, "season", "day", F.lit(1).alias("own"), "pack")
    if f.seasons > 1:  # the state at a season's start: the last game of the latest season before it
        last = days.groupBy(*_KEY, "season").agg(F.max_by("pack", "x").alias("pack")).withColumn("season", F.explode(F.sequence(F.col("season") + 1, F.col("season") + f.seasons - 1)))
        last = last.groupBy(*_KEY, "season").agg(F.max_by("pack", "pack.x").alias("pack"))
        points = points.unionByName(last.select(*_KEY, "season", F.lit(None).cast(points.schema["day"].dataType).alias("day"), F.lit(0).alias("own"), "pack"))
    return points


def _group_sums(r: DataFrame, snapshots: DataFrame) -> DataFrame:
    """metric, kind, season, day and the sums over all entities as known before each snapshot (season, day), from _read's rows of _group_points."""
    w = Window.partitionBy(*_KEY, "season").orderBy("own", "pack.x")
    r = r.withColumns({f"d_{c}": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0)) for c in _SUMS})
    early = F.lit("0001-01-02").cast(r.schema["day"].dataType)
    by = r.groupBy("metric", "kind", "season", F.coalesce("day", early).alias("day")).agg(*[F.sum(f"d_{c}").alias(c) for c in _SUMS])
    by = staged(running(staged(by, "changes"), ["metric", "kind", "season"], ["day"], _SUMS, F.lit(0), inclusive=True), "totals")  # a row per day of a season
    grid = snapshots.select("season", "day").distinct().join(by.select("metric", "kind", "season").distinct(), "season")
    return last_before(grid, by, ["metric", "kind", "season"], "day", "day", {f"g_{c}": f"before_{c}" for c in _SUMS}, strict=True, width=400 * DAY)


def _league(history: DataFrame, snapshots: DataFrame, kind: str, metrics: Sequence[Metric], f: Fading) -> DataFrame:
    """metric, season, day, league_mean, league_sd: exposure-weighted over all games before the snapshot, shrunk to the metric's prior."""
    v, e = F.col("value"), F.col("exposure")
    by = history.where(F.col("kind") == kind).groupBy("metric", F.col("season").alias("of"), "day").agg(F.sum(e).alias("w"), F.sum(e * v).alias("wv"), F.sum(e * v * v).alias("wvv"))
    by = staged(running(staged(by, "days"), ["metric", "of"], ["day"], _SUMS, F.lit(0), inclusive=True), "league")  # a row per day of a season
    days = snapshots.select("season", "day").distinct()
    grid = days.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(f.seasons - 1)))).withColumn("of", F.col("season") - F.col("age"))
    grid = grid.withColumn("metric", F.explode(F.array(*[F.lit(m.name) for m in metrics])))
    met = last_before(grid, by, ["metric", "of"], "day", "day", {c: f"before_{c}" for c in _SUMS}, strict=True, width=400 * DAY)
    t = met.groupBy("metric", "season", "day").agg(*[F.coalesce(F.sum(F.col(c) * F.pow(F.lit(f.decay), F.col("age"))), F.lit(0.0)).alias(c) for c in _SUMS])
    m0, sd0, least = _of(metrics, "mean"), _of(metrics, "sd"), _of(metrics, "least_sd")
    known = F.col("w") / (F.col("w") + _of(metrics, "strength") * 8)
    mean = F.col("wv") / F.col("w")
    spread = F.greatest(F.col("wvv") / F.col("w") - mean * mean, least * least)
    sd = F.greatest(F.sqrt(known * spread + (1 - known) * sd0 * sd0), least)
    some = F.col("w") > 0
    return t.select("metric", "season", "day", _bounded(F.when(some, m0 + known * (mean - m0)).otherwise(m0), metrics).alias("league_mean"), F.when(some, sd).otherwise(sd0).alias("league_sd"))


def priors_before(history: DataFrame, wanted: DataFrame, metrics: Sequence[Metric], f: Fading = Fading(), league_kind: str | None = None) -> DataFrame:
    """wanted (kind, entity, season, day) per metric with mean, sd, effective, weight, league_mean and league_sd before that day.

    history: long_history's table. An entity's mean goes to the mean over all entities of its kind by effective / (effective +
    strength). One of which nothing counts has the league's mean and sd, effective 0 and weight 0.
    """
    history = staged(history, "history")
    ledger = _ledger(history, f)
    rows = wanted.select("kind", F.col("entity").cast("string").alias("entity"), F.col("season").cast("int").alias("season"), "day").distinct()
    rows = staged(rows, "wanted")
    days = staged(rows.select("season", "day").distinct(), "snapshots")
    league = _league(history, days, league_kind or "player", metrics, f)
    each = rows.withColumn("metric", F.explode(F.array(*[F.lit(m.name) for m in metrics])))
    ends = _day_ends(ledger)
    known = staged(last_before(each, ends, _KEY, "day", "day", {"pack": "pack"}, strict=True, ties=["x"], width=90 * DAY), "known")
    points = known.where("pack IS NOT NULL").withColumn("own", F.lit(2)).unionByName(_group_points(ends, f))
    read = staged(_read(points, ledger, ends, f), "read")  # one pass over the ledger for entities and groups
    rows = read.where("own = 2").drop("own").unionByName(known.where("pack IS NULL").withColumns({c: F.lit(0.0) for c in _SUMS}))
    j = rows.join(_group_sums(read.where("own < 2"), days), ["metric", "kind", "season", "day"], "left").join(league, ["metric", "season", "day"], "left")
    least = _of(metrics, "least_sd")
    some = (F.col("w") > 0) & (F.col("g_w") > 0)
    share = F.when(some, F.col("w") / (F.col("w") + _of(metrics, "strength"))).otherwise(0.0)
    group = F.col("g_wv") / F.col("g_w")
    spread = F.greatest(F.col("g_wvv") / F.col("g_w") - group * group, least * least)
    mean = F.when(some, group + share * (F.col("wv") / F.col("w") - group)).otherwise(F.col("league_mean"))
    sd = F.when(some, F.greatest(F.sqrt(spread * (1 - share)), least)).otherwise(F.col("league_sd"))
    return j.select("kind", "entity", "season", "day", "metric", _bounded(mean, metrics).alias("mean"), sd.alias("sd"), F.when(some, F.col("w")).otherwise(0.0).alias("effective"), share.alias("weight"), "league_mean", "league_sd")


def starter_features(games: DataFrame, candidates: DataFrame, metrics: Sequence[Metric], f: Fading = Fading(), *, game: str, team: str, player: str, probability: str, day: str, season: str, order: Sequence[str]) -> DataFrame:
    """Per game, team and metric: the mixture of its candidates' priors by their normalised probabilities, beside the team's own prior.

    games: history, one row per game and player (team, player, day, season, the metrics and exposures). candidates: game,
    team, player, probability, day, season. Only history of strictly earlier days counts. Null probabilities count as 0; a
    game and team whose probabilities come to 0 fail the query. Columns: candidates, expected (the likeliest, least id on
    ties), entropy, mean, sd, effective, weight, team_mean, team_sd, delta, league_mean.
    """
    history = long_history(games.withColumnsRenamed({player: "player", team: "team"}), metrics, ["player", "team"], day, season, order)
    c = candidates.select(F.col(game).alias("game"), F.col(team).cast("string").alias("team"), F.col(player).cast("string").alias("player"), F.col(day).alias("day"), F.col(season).cast("int").alias("season"), F.coalesce(F.col(probability).cast("double"), F.lit(0.0)).alias("p"))
    total = F.sum("p").over(Window.partitionBy("game", "team"))
    c = c.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(F.raise_error(F.lit("the probabilities of a game's candidates come to 0")).cast("double")))
    who = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("entity")) for k in ("player", "team")])
    wanted = c.select("season", "day", F.explode(who).alias("k")).select("k.*", "season", "day")
    prior = staged(priors_before(history, wanted, metrics, f), "priors")
    mine = prior.where("kind = 'player'").withColumnRenamed("entity", "player").drop("kind")
    theirs = prior.where("kind = 'team'").select(F.col("entity").alias("team"), "season", "day", "metric", F.col("mean").alias("team_mean"), F.col("sd").alias("team_sd"))
    j = c.join(mine, ["player", "season", "day"])
    first, second = F.sum(F.col("p") * F.col("mean")), F.sum(F.col("p") * (F.col("sd") ** 2 + F.col("mean") ** 2))
    mix = j.groupBy("game", "team", "season", "day", "metric").agg(
        F.count("*").alias("candidates"), F.min_by("player", F.struct(-F.col("p"), "player")).alias("expected"),
        (-F.sum(F.col("p") * F.log(F.greatest("p", F.lit(1e-12))))).alias("entropy"), first.alias("mean"), F.sqrt(F.greatest(second - first * first, F.lit(0.0))).alias("sd"),
        F.sum(F.col("p") * F.col("effective")).alias("effective"), F.sum(F.col("p") * F.col("weight")).alias("weight"), F.first("league_mean").alias("league_mean"),
    )
    out = mix.join(theirs, ["team", "season", "day", "metric"]).withColumn("delta", F.col("mean") - F.col("team_mean"))
    return out.withColumns({"mean": _bounded(F.col("mean"), metrics), "sd": F.greatest("sd", _of(metrics, "least_sd")), "team_sd": F.greatest("team_sd", _of(metrics, "least_sd"))})
