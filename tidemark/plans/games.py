"""Queries over plays: order lines stand for plays, suppliers for games, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import games
from tidemark.plans.registry import query, r6, read

#: Lines as plays: name and expression, which reads the same in Spark's and DuckDB's SQL.
PLAY = {
    "game_id": "l_suppkey", "posteam": "l_linenumber % 2", "defteam": "1 - l_linenumber % 2", "drive": "l_orderkey % 9", "passer_player_id": "l_partkey % 3",
    "play_type": "CASE l_partkey % 12 WHEN 0 THEN 'punt' WHEN 1 THEN 'Kickoff ' WHEN 2 THEN 'field_goal' WHEN 3 THEN 'extra_point' WHEN 4 THEN 'no_play' WHEN 5 THEN 'qb_spike' ELSE 'run' END",
    "qb_kneel": "CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END", "qb_dropback": "CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END", "pass_attempt": "CASE WHEN l_quantity >= 28 THEN 1 ELSE 0 END",
    "rush_attempt": "CASE WHEN l_quantity <= 26 THEN 1 ELSE 0 END", "scramble": "CASE WHEN l_quantity = 26 THEN 1 ELSE 0 END", "complete_pass": "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END",
    "sack": "CASE WHEN l_quantity < 28 AND l_returnflag = 'N' THEN 1 ELSE 0 END", "interception": "CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END", "fumble_lost": "CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END",
    "touchdown": "CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END", "penalty": "CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END", "goal_to_go": "CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END",
    "no_huddle": "CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END", "shotgun": "CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END", "third_down_converted": "CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END", "fourth_down_converted": "CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END",
    "down": "CASE WHEN l_orderkey % 29 <> 0 THEN l_orderkey % 4 + 1 END", "yardline_100": "CASE WHEN l_partkey % 31 <> 0 THEN l_partkey % 100 END", "score_differential": "l_orderkey % 41 - 20", "game_seconds_remaining": "l_orderkey * 7 % 3600",
    "half_seconds_remaining": "l_orderkey * 7 % 1800", "epa": "CASE WHEN l_orderkey % 37 <> 0 THEN l_partkey % 700 - 350 END", "success": "CASE WHEN l_partkey % 700 > 350 THEN 1 ELSE 0 END", "cpoe": "l_partkey % 60 - 30",
    "air_yards": "CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 45 END", "passing_yards": "l_partkey % 45", "rushing_yards": "l_partkey % 21 - 3", "posteam_score": "l_orderkey % 30", "posteam_score_post": "l_orderkey % 30 + l_linenumber",
}


def plays(spark, sf):
    return read(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in PLAY.items()])


_PLAYS = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in PLAY.items()) + " FROM lineitem)"
#: The masks again in SQL, over tests of their own.
_MASKS = {
    "play": "true", "scrimmage": "s", "competitive": "s AND abs(score_differential) <= CASE WHEN game_seconds_remaining > 1800 THEN 24 WHEN game_seconds_remaining > 900 THEN 20 WHEN game_seconds_remaining > 300 THEN 16 ELSE 8 END",
    "neutral": "s AND score_differential BETWEEN -8 AND 8 AND game_seconds_remaining > 300", "early": "s AND down IN (1, 2)", "late": "s AND down IN (3, 4)", "two_minute": "s AND half_seconds_remaining BETWEEN 1 AND 120",
    "red_zone": "s AND yardline_100 <= 20", "dropback": "s AND qb_dropback = 1", "pass": "s AND pass_attempt = 1", "rush": "s AND rush_attempt = 1", "designed": "NOT idle AND rush_attempt = 1 AND scramble = 0",
    "scramble": "s AND scramble = 1", "completion": "s AND pass_attempt + complete_pass = 2", "long_pass": "s AND pass_attempt = 1 AND passing_yards >= 20", "long_rush": "NOT idle AND rush_attempt = 1 AND scramble = 0 AND rushing_yards >= 10",
    "sack": "s AND sack + qb_dropback = 2", "interception": "s AND interception = 1", "pass_interception": "s AND interception + pass_attempt = 2", "fumble": "s AND fumble_lost = 1", "turnover": "s AND interception + fumble_lost > 0",
    "third": "s AND down = 3", "third_made": "s AND down = 3 AND third_down_converted = 1", "fourth": "s AND down = 4", "fourth_made": "s AND down = 4 AND fourth_down_converted = 1", "no_huddle": "s AND no_huddle = 1",
    "shotgun": "s AND shotgun = 1", "penalty": "penalty = 1", "special": "kick IN ('punt', 'kickoff', 'field_goal', 'extra_point')", "touchdown": "s AND touchdown = 1", "pass_touchdown": "s AND touchdown + pass_attempt = 2",
    "dropback_scramble": "s AND qb_dropback + scramble = 2", "punt": "kick = 'punt'", "kickoff": "kick = 'kickoff'", "field_goal": "kick = 'field_goal'", "extra_point": "kick = 'extra_point'",
}
_MASKS["neutral_dropback"], _MASKS["competitive_dropback"] = (f"{_MASKS[m]} AND qb_dropback = 1" for m in ("neutral", "competitive"))
_MARKED = f"""(SELECT *, trim(lower(play_type)) AS kick, (qb_dropback = 1 OR rush_attempt = 1) AND NOT idle AS s
FROM (SELECT *, play_type IN ('no_play', 'qb_spike') OR qb_kneel = 1 AS idle FROM {_PLAYS}))"""


def _metric_sql(how: tuple) -> str:
    kind, *of = how
    if kind == "n":
        return f"count(*) FILTER (WHERE {_MASKS[of[0]]})"
    if kind == "rate":
        return f"round(count(*) FILTER (WHERE {_MASKS[of[0]]}) / nullif(count(*) FILTER (WHERE {_MASKS[of[1]]}), 0)::DOUBLE, 6)"
    x = f"{'avg' if kind == 'mean' else 'sum'}({of[0]}) FILTER (WHERE {_MASKS[of[1]]})"
    return f"round({x}, 6)" if kind == "mean" else f"coalesce({x}, 0)::DOUBLE"


_TEAM = ", ".join(f"{_metric_sql(m)} AS {k}" for k, m in games.TEAM_METRICS.items())
_DRIVES = f"""(SELECT game_id, posteam, count(*) AS drives, round(sum(points) / count(*)::DOUBLE, 6) AS points_per_drive, round(sum(plays) / count(*)::DOUBLE, 6) AS scrimmage_plays_per_drive, round(avg(field), 6) AS average_starting_field_position,
  count(*) FILTER (WHERE red) AS red_zone_drives, round(count(*) FILTER (WHERE red_td) / nullif(count(*) FILTER (WHERE red), 0)::DOUBLE, 6) AS red_zone_td_rate,
  count(*) FILTER (WHERE goal) AS goal_to_go_drives, round(count(*) FILTER (WHERE goal_td) / nullif(count(*) FILTER (WHERE goal), 0)::DOUBLE, 6) AS goal_to_go_td_rate
FROM (SELECT game_id, posteam, drive, greatest(max(posteam_score_post) - min(posteam_score), 0) AS points, count(*) FILTER (WHERE s) AS plays, bool_or(coalesce(yardline_100 <= 20, false)) AS red,
  100 - (min((-game_seconds_remaining, yardline_100)) FILTER (WHERE yardline_100 IS NOT NULL))[2] AS field,
  bool_or(coalesce(yardline_100 <= 20, false) AND touchdown = 1) AS red_td, bool_or(goal_to_go = 1) AS goal, bool_or(goal_to_go = 1 AND touchdown = 1) AS goal_td FROM {_MARKED} GROUP BY ALL) GROUP BY ALL)"""
_ALL = [*games.TEAM_METRICS, "drives", "points_per_drive", "scrimmage_plays_per_drive", "average_starting_field_position", "red_zone_drives", "red_zone_td_rate", "goal_to_go_drives", "goal_to_go_td_rate"]


def _sides() -> str:
    special = lambda c: c.startswith(games.SPECIAL)
    return ", ".join([f"a.{c} AS {c if special(c) else 'offense_' + c}" for c in _ALL] + [f"b.{c} AS {'opponent_' if special(c) else 'defense_allowed_'}{c}" for c in _ALL])


def six(df):
    return df.withColumns({c: r6(F.col(c)) for c, t in df.dtypes if t == "double"})


@query(f"""
WITH g AS (SELECT t.*, d.* EXCLUDE (game_id, posteam) FROM (SELECT game_id, posteam, defteam, {_TEAM} FROM {_MARKED} GROUP BY ALL) t JOIN {_DRIVES} d USING (game_id, posteam))
SELECT a.game_id, a.posteam AS team_id, a.defteam AS opponent_id, {_sides()} FROM g a LEFT JOIN g b ON a.game_id = b.game_id AND a.posteam = b.defteam AND a.defteam = b.posteam""")
def team_game_metrics(spark, sf):
    return six(games.team_games(plays(spark, sf)))


@query(f"""
SELECT * FROM (SELECT game_id, posteam AS team_id, passer_player_id AS player_id, {', '.join(f'{_metric_sql(m)} AS {k}' for k, m in games.PASSER_METRICS.items())} FROM {_MARKED} GROUP BY ALL) WHERE dropbacks > 0""")
def passer_game_metrics(spark, sf):
    return six(games.passer_games(plays(spark, sf)))
