"""Features of games to come, by rows put into history without results and taken out again after the same windows.

Only games that were known to be over, and their plays, are history; the rows of games to come have no metrics, so no
window can read anything of theirs, and every game of history has the features that it has without them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import gates, windows
from tidemark.operators.games import team_games
from tidemark.operators.stages import staged

#: The metrics of a side's games that features read, and the windows over them.
METRICS = ("offense_epa_per_play", "offense_success_rate", "offense_dropback_epa", "offense_rush_epa", "defense_allowed_epa_per_play")
WINDOWS = ("last4", "season")
#: Columns that hold a game's status, and when it was over, by rank.
STATUS, COMPLETED = ("game_status", "status"), ("completion_timestamp_utc", "game_end_utc", "end_time_utc")


def matchups(window: str) -> dict[str, Column]:
    """A window's features of a game from the columns home_<metric>_<window>_mean and away_<metric>_<window>_mean."""
    of = lambda side, metric: F.col(f"{side}_{metric}_{window}_mean")
    home = of("home", "offense_epa_per_play") - of("away", "defense_allowed_epa_per_play")
    away = of("away", "offense_epa_per_play") - of("home", "defense_allowed_epa_per_play")
    net = {n: of("home", m) - of("away", m) for n, m in {"success_rate_net": "offense_success_rate", "dropback_epa_net": "offense_dropback_epa", "rush_epa_net": "offense_rush_epa"}.items()}
    return {f"{n}_{window}_mean": c for n, c in {"epa_matchup_home": home, "epa_matchup_away": away, "epa_net_edge": home - away, **net}.items()}


def features() -> list[str]:
    """The columns of a game's features, in their order."""
    return ["home_spread", "total_line", *[n for w in WINDOWS for n in matchups(w)], "home_rest_days", "away_rest_days", "rest_diff", "home_short_week", "away_short_week"]


def _moment(as_of: datetime | str) -> Column:
    return F.lit(as_of).cast("timestamp")


def known_games(history: DataFrame, as_of: datetime | str, replay: bool = False) -> DataFrame:
    """history with finality, reason, verified, assumed and eligible as of the moment; see gates.finality."""
    have = set(history.columns)
    first = lambda names, kind: next((F.col(c) for c in names if c in have), F.lit(None)).try_cast(kind)
    h = history.withColumns({"kickoff": F.col("scheduled_kickoff_utc").try_cast("timestamp"), "_status": first(STATUS, "string"), "_done": first(COMPLETED, "timestamp"), "_last": F.lit(None).cast("timestamp")})
    # a time of completion verifies, whatever the status says, unless it says that the game goes on
    h = gates.finality(h, _moment(as_of), "kickoff", "_status", "_done", "_last", replay)
    return h.withColumn("eligible", F.col("verified") | F.col("assumed") if replay else F.col("verified")).drop("_status", "_done", "_last")


def side_sequence(team_rows: DataFrame, schedule: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Every side's game with the means of its earlier games: over the last four and over the season so far.

    team_rows: game_id, team_id and the metrics (null in rows without a result); schedule: game_id, season, kickoff.
    """
    rows = team_rows.select("game_id", "team_id", *metrics).join(schedule.select("game_id", "season", "kickoff"), "game_id")
    return windows.prior_features(rows, ["team_id"], ["kickoff", "game_id"], metrics, "season", (4,))


def game_features(sequence: DataFrame, schedule: DataFrame, games: DataFrame) -> DataFrame:
    """One row per game of `games`: game_id and features(), from both sides' rows of the sequence and of the schedule."""
    means = [f"{m}_{w}_mean" for m in METRICS for w in WINDOWS]
    long = schedule.select("game_id", "kickoff", F.explode(F.array(*[F.struct(F.col(f"{v}_team_id").alias("team_id"), F.lit(v).alias("venue")) for v in ("home", "away")])).alias("s")).select("game_id", "kickoff", "s.*")
    rest = windows.rest_days(long, ["team_id"], ["kickoff", "game_id"], "kickoff")
    wanted = games.select("game_id").join(rest, "game_id").join(sequence.select("game_id", "team_id", *means), ["game_id", "team_id"], "left")
    both = wanted.groupBy("game_id").agg(*[F.max(F.when(F.col("venue") == v, F.struct("rest_days", "short_rest", *means))).alias(v) for v in ("home", "away")])
    flat = both.select("game_id", *[F.col(f"{v}.{c}").alias(f"{v}_{c}") for v in ("home", "away") for c in ("rest_days", "short_rest", *means)])
    out = games.select("game_id", *[F.col(c).cast("double").alias(c) for c in ("home_spread", "total_line")]).join(flat, "game_id", "left")
    out = out.withColumns({n: c for w in WINDOWS for n, c in matchups(w).items()} | {"rest_diff": F.col("home_rest_days") - F.col("away_rest_days")} | {f"{v}_short_week": F.col(f"{v}_short_rest").cast("double") for v in ("home", "away")})
    return out.select("game_id", *features())


def live_features(history: DataFrame, targets: DataFrame, plays: DataFrame, as_of: datetime | str, replay: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, status) of games to come: a row per target with features(), and one row of counts.

    history: game_id, season, home_team_id, away_team_id, scheduled_kickoff_utc and, if there, a status and a time of completion; targets the same,
    with home_spread and total_line; plays as in team_games, with start_time if there. A target's own scores and plays are
    never read. Targets that repeat, or start at or before the moment (or at no time), raise ValueError. Without any game
    that was over, metrics and rest are null and the lines stand.
    """
    now = _moment(as_of)
    t = targets.withColumn("kickoff", F.col("scheduled_kickoff_utc").try_cast("timestamp"))
    wrong = t.groupBy("game_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("kickoff") > now, F.lit(False))).alias("later")).where("n > 1 OR NOT later").orderBy("game_id").first()
    if wrong:
        raise ValueError(f"target {wrong['game_id']} " + ("repeats" if wrong["n"] > 1 else "starts at or before the moment"))
    known = staged(known_games(history, as_of, replay), "known-games")
    over = known.where("eligible")
    seen = plays.withColumn("_late", F.coalesce(F.col("start_time").try_cast("timestamp") > now, F.lit(False)) if "start_time" in plays.columns else F.lit(False))
    seen = seen.join(over.select("game_id", F.lit(True).alias("_over")).distinct(), "game_id", "left")
    used = seen.where("_over AND NOT _late").drop("_over", "_late")
    done = team_games(used)
    done = done.select("game_id", "team_id", *[F.col(m).cast("double").alias(m) if m in done.columns else F.lit(None).cast("double").alias(m) for m in METRICS])
    coming = t.select("game_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), *[F.lit(None).cast("double").alias(m) for m in METRICS])
    keep = ["game_id", "season", "home_team_id", "away_team_id", "kickoff"]
    schedule = over.select(*keep).unionByName(t.select(*keep))
    out = staged(game_features(side_sequence(done.unionByName(coming), schedule, METRICS), schedule, t), "live-features")
    count = lambda c: F.count_if(F.col("finality") == c)
    states = known.agg(
        F.count_if("eligible").alias("eligible_games"), F.count_if("verified").alias("verified_games"), F.count_if("assumed").alias("assumed_games"), count("IN_PROGRESS_AT_ASOF").alias("in_progress_games"),
        count("UNKNOWN_FINALITY").alias("unknown_games"), count("POST_ASOF_KICKOFF").alias("later_games"), count("EXPLICIT_NON_FINAL").alias("open_games"), F.max(F.when(F.col("eligible"), F.col("kickoff"))).alias("last_kickoff"),
    )
    cut = seen.agg(F.count_if(F.col("_late") | F.col("_over").isNull()).alias("plays_left_out"))
    row = F.xxhash64("game_id", *[F.round(F.col(c), 10) for c in features()])
    made = out.agg(F.count("*").alias("rows"), F.hex(F.coalesce(F.bit_xor(row), F.lit(0))).alias("snapshot"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in features()])
    return out, states.join(cut).join(made)  # one row each
