"""Plays to team games and passer games: masks, one conditional aggregate, drives in two levels, mirrored sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag, number
from tidemark.operators.stages import staged

#: Margins within which a play is competitive, by the least seconds left; the last holds from 0 on.
COMPETITIVE = ((1800, 24.0), (900, 20.0), (300, 16.0), (-1, 8.0))
NEUTRAL_MARGIN, NEUTRAL_SECONDS, LONG_PASS, LONG_RUSH = 8.0, 300.0, 20.0, 10.0
KICKS = ("field_goal", "extra_point", "punt", "kickoff")
#: The metrics of a team's game as ("n", mask), ("mean", value, mask) or ("rate", mask, of mask).
TEAM_METRICS = {
    "raw_play_rows": ("n", "play"), "scrimmage_plays": ("n", "scrimmage"), "competitive_scrimmage_plays": ("n", "competitive"), "neutral_scrimmage_plays": ("n", "neutral"),
    "neutral_dropbacks": ("n", "neutral_dropback"), "neutral_situation_pass_rate": ("rate", "neutral_dropback", "neutral"), "early_down_plays": ("n", "early"), "late_down_plays": ("n", "late"),
    "two_minute_plays": ("n", "two_minute"), "red_zone_plays": ("n", "red_zone"), "dropbacks": ("n", "dropback"), "pass_attempts": ("n", "pass"), "rush_attempts": ("n", "rush"),
    "designed_rushes": ("n", "designed"), "scrambles": ("n", "scramble"), "epa_per_play": ("mean", "epa", "scrimmage"), "success_rate": ("mean", "success", "scrimmage"),
    "competitive_epa_per_play": ("mean", "epa", "competitive"), "competitive_success_rate": ("mean", "success", "competitive"), "neutral_epa_per_play": ("mean", "epa", "neutral"), "neutral_success_rate": ("mean", "success", "neutral"),
    "early_down_epa": ("mean", "epa", "early"), "early_down_success_rate": ("mean", "success", "early"), "late_down_epa": ("mean", "epa", "late"), "late_down_success_rate": ("mean", "success", "late"),
    "two_minute_epa": ("mean", "epa", "two_minute"), "two_minute_success_rate": ("mean", "success", "two_minute"), "red_zone_epa": ("mean", "epa", "red_zone"), "red_zone_success_rate": ("mean", "success", "red_zone"),
    "dropback_epa": ("mean", "epa", "dropback"), "dropback_success_rate": ("mean", "success", "dropback"), "pass_attempt_epa": ("mean", "epa", "pass"), "completion_rate": ("rate", "completion", "pass"),
    "cpoe": ("mean", "cpoe", "pass"), "air_yards_per_attempt": ("mean", "air_yards", "pass"), "rush_epa": ("mean", "epa", "rush"), "rush_success_rate": ("mean", "success", "rush"),
    "designed_rush_epa": ("mean", "epa", "designed"), "designed_rush_success_rate": ("mean", "success", "designed"), "scramble_epa": ("mean", "epa", "scramble"), "scramble_success_rate": ("mean", "success", "scramble"),
    "explosive_pass_rate": ("rate", "long_pass", "pass"), "explosive_rush_rate": ("rate", "long_rush", "designed"), "sacks": ("n", "sack"), "sack_rate": ("rate", "sack", "dropback"),
    "interceptions": ("n", "interception"), "interception_rate": ("rate", "pass_interception", "pass"), "fumbles_lost": ("n", "fumble"), "turnovers": ("n", "turnover"), "turnover_rate": ("rate", "turnover", "scrimmage"),
    "third_down_attempts": ("n", "third"), "third_down_conversion_rate": ("rate", "third_made", "third"), "fourth_down_attempts": ("n", "fourth"), "fourth_down_conversion_rate": ("rate", "fourth_made", "fourth"),
    "no_huddle_rate": ("rate", "no_huddle", "scrimmage"), "shotgun_rate": ("rate", "shotgun", "scrimmage"), "penalty_events": ("n", "penalty"), "penalty_rate": ("rate", "penalty", "scrimmage"),
    "special_teams_plays": ("n", "special"), "special_teams_epa_per_play": ("mean", "epa", "special"), "field_goal_attempts": ("n", "field_goal"), "field_goal_epa_per_attempt": ("mean", "epa", "field_goal"),
    "extra_point_attempts": ("n", "extra_point"), "extra_point_epa_per_attempt": ("mean", "epa", "extra_point"), "punt_attempts": ("n", "punt"), "punt_epa_per_attempt": ("mean", "epa", "punt"),
    "kickoff_attempts": ("n", "kickoff"), "kickoff_epa_per_attempt": ("mean", "epa", "kickoff"), "touchdowns": ("n", "touchdown"),
}
#: The metrics of a passer's game.
PASSER_METRICS = {
    "dropbacks": ("n", "dropback"), "attempts": ("n", "pass"), "completions": ("n", "completion"), "passing_yards": ("sum", "passing_yards", "pass"), "passing_touchdowns": ("n", "pass_touchdown"),
    "interceptions": ("n", "pass_interception"), "sacks": ("n", "sack"), "scrambles": ("n", "dropback_scramble"), "epa_per_dropback": ("mean", "epa", "dropback"), "success_rate": ("mean", "success", "dropback"),
    "competitive_epa_per_dropback": ("mean", "epa", "competitive_dropback"), "neutral_epa_per_dropback": ("mean", "epa", "neutral_dropback"), "completion_rate": ("rate", "completion", "pass"), "cpoe": ("mean", "cpoe", "pass"),
    "air_yards_per_attempt": ("mean", "air_yards", "pass"), "explosive_pass_rate": ("rate", "long_pass", "pass"), "sack_rate": ("rate", "sack", "dropback"), "interception_rate": ("rate", "pass_interception", "pass"),
}
SPECIAL = ("special_teams", "field_goal", "extra_point", "punt", "kickoff")
VALUES = ("epa", "success", "cpoe", "air_yards", "passing_yards")


def _masks(plays: DataFrame) -> dict[str, Column]:
    """Boolean columns, never null. A column that plays lacks counts as absent throughout: no flag, no number."""
    have = set(plays.columns)
    on = lambda c: flag(c) if c in have else F.lit(False)
    num = lambda c, d=None: F.coalesce(number(c), F.lit(d)) if c in have and d is not None else number(c) if c in have else F.lit(d).cast("double")
    sure = lambda c: F.coalesce(c, F.lit(False))
    kind = F.coalesce(F.lower(F.trim(F.col("play_type"))), F.lit("")) if "play_type" in have else F.lit("")
    dead = on("no_play") | (kind == "no_play")
    idle = dead | on("qb_kneel") | kind.isin("qb_kneel", "qb_spike")
    scrimmage = (on("qb_dropback") | on("rush_attempt")) & ~idle
    left, margin, down, yards = num("game_seconds_remaining", 0.0), F.abs(num("score_differential", 0.0)), num("down"), num("yardline_100")
    half = num("half_seconds_remaining")
    limit = None
    for seconds, most in COMPETITIVE:
        limit = F.when(left > seconds, most) if limit is None else limit.when(left > seconds, most)
    close = scrimmage & sure(margin <= F.coalesce(limit, F.lit(COMPETITIVE[-1][1])))
    neutral = scrimmage & (margin <= NEUTRAL_MARGIN) & (left > NEUTRAL_SECONDS)
    dropback, passed = on("qb_dropback") & scrimmage, on("pass_attempt") & scrimmage
    designed = on("rush_attempt") & ~on("scramble") & ~idle
    special = (on("special_teams_play") | kind.isin(*KICKS)) & ~dead
    third, fourth = scrimmage & sure(down == 3), scrimmage & sure(down == 4)
    out = {
        "play": F.lit(True), "scrimmage": scrimmage, "competitive": close, "neutral": neutral, "neutral_dropback": neutral & dropback, "competitive_dropback": close & dropback,
        "early": scrimmage & sure(down <= 2), "late": scrimmage & sure(down >= 3), "two_minute": scrimmage & sure((half > 0) & (half <= 120)), "red_zone": scrimmage & sure(yards <= 20),
        "dropback": dropback, "pass": passed, "rush": on("rush_attempt") & scrimmage, "designed": designed, "scramble": on("scramble") & scrimmage, "dropback_scramble": on("scramble") & dropback,
        "completion": on("complete_pass") & passed, "long_pass": passed & (num("passing_yards", 0.0) >= LONG_PASS), "long_rush": designed & (num("rushing_yards", 0.0) >= LONG_RUSH),
        "sack": on("sack") & dropback, "interception": on("interception") & scrimmage, "pass_interception": on("interception") & passed, "fumble": on("fumble_lost") & scrimmage,
        "turnover": (on("interception") | on("fumble_lost")) & scrimmage, "third": third, "third_made": on("third_down_converted") & third, "fourth": fourth, "fourth_made": on("fourth_down_converted") & fourth,
        "no_huddle": on("no_huddle") & scrimmage, "shotgun": on("shotgun") & scrimmage, "penalty": on("penalty"), "special": special, "touchdown": on("touchdown") & scrimmage, "pass_touchdown": on("touchdown") & passed,
    }
    return out | {k: special & (kind == k) for k in KICKS}


def _measured(plays: DataFrame) -> DataFrame:
    """plays with the masks as columns m_*, and the values as numbers."""
    values = {c: number(c) if c in plays.columns else F.lit(None).cast("double") for c in VALUES}
    return plays.withColumns({f"m_{k}": c for k, c in _masks(plays).items()} | {f"v_{k}": c for k, c in values.items()})


def _metric(how: tuple) -> Column:
    kind, *of = how
    if kind == "n":
        return F.count_if(F.col(f"m_{of[0]}"))
    if kind == "rate":
        return F.try_divide(F.count_if(F.col(f"m_{of[0]}")), F.count_if(F.col(f"m_{of[1]}")))
    x = F.when(F.col(f"m_{of[1]}"), F.col(f"v_{of[0]}"))
    return F.avg(x) if kind == "mean" else F.coalesce(F.sum(x), F.lit(0.0))


def drive_metrics(plays: DataFrame) -> DataFrame:
    """game_id, team_id, opponent_id and eight drive metrics, drive by drive first; plays without a drive are left out."""
    p = _measured(plays).where("drive IS NOT NULL")
    team = [F.col("game_id"), F.col("posteam").alias("team_id"), F.col("defteam").alias("opponent_id")]
    red, goal, six = F.coalesce(number("yardline_100") <= 20, F.lit(False)), flag("goal_to_go"), flag("touchdown")
    first = F.min(F.when(number("yardline_100").isNotNull(), F.struct(-F.coalesce(number("game_seconds_remaining"), F.lit(-1.0)), number("yardline_100").alias("y"))))
    drive = p.groupBy(*team, "drive").agg(
        F.greatest(F.max(number("posteam_score_post")) - F.min(number("posteam_score")), F.lit(0.0)).alias("points"), F.count_if("m_scrimmage").alias("plays"), (100 - first["y"]).alias("field"),
        F.bool_or(red).alias("red"), F.bool_or(red & six).alias("red_td"), F.bool_or(goal).alias("goal"), F.bool_or(goal & six).alias("goal_td"),
    )
    n = F.count("*")
    return drive.groupBy("game_id", "team_id", "opponent_id").agg(
        n.alias("drives"), (F.coalesce(F.sum("points"), F.lit(0.0)) / n).alias("points_per_drive"), (F.sum("plays") / n).alias("scrimmage_plays_per_drive"), F.avg("field").alias("average_starting_field_position"),
        F.count_if("red").alias("red_zone_drives"), F.try_divide(F.count_if("red_td"), F.count_if("red")).alias("red_zone_td_rate"),
        F.count_if("goal").alias("goal_to_go_drives"), F.try_divide(F.count_if("goal_td"), F.count_if("goal")).alias("goal_to_go_td_rate"),
    )


def team_games(plays: DataFrame) -> DataFrame:
    """A row per game and side: offense_* metrics, kicking metrics under their own names, and the other side's as
    defense_allowed_* and opponent_*.

    plays: game_id, posteam, defteam and the play-by-play columns that there are. Plays without a side are left out.
    One aggregate gives all masked metrics; sides are then joined with their opponents.
    """
    plays = plays.where("game_id IS NOT NULL AND posteam IS NOT NULL")
    key = ["game_id", "team_id", "opponent_id"]
    own = _measured(plays).groupBy("game_id", F.col("posteam").alias("team_id"), F.col("defteam").alias("opponent_id")).agg(*[_metric(m).alias(k) for k, m in TEAM_METRICS.items()])
    drives = drive_metrics(plays) if "drive" in plays.columns else None
    both = own if drives is None else own.join(drives, key, "left").fillna(0, [c for c in drives.columns if c.endswith("drives")])
    both = staged(both, "team-games")  # both sides read it: plays are aggregated once
    metrics = [c for c in both.columns if c not in key]
    kick = lambda c: c.startswith(SPECIAL)
    offense = both.select(*key, *[F.col(c).alias(c if kick(c) else f"offense_{c}") for c in metrics])
    other = both.select("game_id", F.col("team_id").alias("opponent_id"), F.col("opponent_id").alias("team_id"), *[F.col(c).alias(f"opponent_{c}" if kick(c) else f"defense_allowed_{c}") for c in metrics])
    return offense.join(other, key, "left")


def passer_games(plays: DataFrame) -> DataFrame:
    """A row per game, side and passer (passer_player_id) with at least one dropback."""
    p = _measured(plays.where("game_id IS NOT NULL AND posteam IS NOT NULL AND passer_player_id IS NOT NULL"))
    out = p.groupBy("game_id", F.col("posteam").alias("team_id"), F.col("passer_player_id").alias("player_id")).agg(*[_metric(m).alias(k) for k, m in PASSER_METRICS.items()])
    return out.where("dropbacks > 0")
