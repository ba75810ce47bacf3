"""Availability reports: tables with headers of their own, and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.scalars import canonical_name
from tidemark.operators.gates import first_column

#: The names that a report may give to each column, once header_name has cleaned them.
HEADERS = {
    "team": ("team_id", "team", "team_alias", "club"),
    "player_id": ("player_id", "nfl_player_id"),
    "player_name": ("player", "player_name", "name"),
    "position": ("position", "pos"),
    "injury": ("injuries", "injury", "injury_primary", "body_part"),
    "practice": ("practice_status", "practice_participation"),
    "game": ("game_status", "status"),
    "reported": ("status_date_utc", "report_timestamp_utc", "report_date"),
    "back": ("estimated_return_date",),
}

_PLAYER = (
    "struct<id:string,sr_id:string,name:string,jersey:string,position:string,status:string,"
    "injury:struct<`primary`:string,status:string,status_date:string,estimated_return_date:string,practice:struct<status:string>>>"
)
TEAMS = f"array<struct<id:string,sr_id:string,alias:string,abbreviation:string,market:string,name:string,players:array<{_PLAYER}>,injuries:array<{_PLAYER}>>>"


def header_name(name: str) -> str:
    """Lower case, _ for slashes, spaces and hyphens."""
    return name.strip().lower().translate(str.maketrans("/ -", "___"))


def report(df: DataFrame, season: int, week: int | str, aliases: dict[str, str] | None = None, teams: list[str] | None = None) -> DataFrame:
    """One row per line of a report with settled columns, whatever its headers; a missing column is null.

    Of headers that clean to the same name the first counts. Dates that can't be read are null. A row without a team, or
    with one outside `teams` if that is given, fails the query.
    """
    names = {}
    for c in df.columns:
        names.setdefault(header_name(c), c)
    raw = df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])
    got = {k: first_column(raw, v, None).cast("string") for k, v in HEADERS.items()}
    team = canonical_name(got["team"], aliases)
    known = team.isNotNull() if teams is None else F.coalesce(team.isin(*teams), F.lit(False))
    said = F.concat(F.lit("a report's row has no known team: "), F.coalesce(got["team"], F.lit("null")))
    return raw.select(
        F.lit(int(season)).alias("season"), F.lit(str(week)).alias("week"), F.when(known, team).otherwise(F.raise_error(said).cast("string")).alias("team_id"),
        got["player_id"].alias("player_id"), got["player_name"].alias("player_name"), got["position"].alias("position"), got["injury"].alias("injury"),
        labels.practice(got["practice"]).alias("practice_status"), labels.status(got["game"]).alias("game_status"),
        F.try_to_timestamp(got["reported"]).alias("reported_at"), F.try_to_timestamp(got["back"]).alias("expected_back_at"),
    )


def _teams(payload: Column, wrappers: tuple[str, ...]) -> Column:
    at = lambda path: F.from_json(F.get_json_object(payload, path), TEAMS)
    nested = F.flatten(F.array_compact(F.array(*[at(f"$.{w}.teams") for w in wrappers])))
    return F.coalesce(at("$.teams"), nested)


def flatten(payloads: DataFrame, column: str = "payload", wrappers: tuple[str, ...] = ("week", "league", "season", "week.league", "league.week"), aliases: dict[str, str] | None = None) -> DataFrame:
    """One row per listed player of nested JSON.

    Teams stand at the top, or else under any of `wrappers`; a team's players under players, or else injuries. Broken
    JSON and teams without players give no row; missing levels leave nulls.
    """
    p = F.col(column)
    season, week = (F.get_json_object(p, path) for path in ("$.season.year", "$.week.sequence"))
    t = payloads.select(season.try_cast("int").alias("season"), week.alias("week"), F.explode(_teams(p, wrappers)).alias("t"))
    r = t.select("season", "week", "t", F.explode(F.coalesce("t.players", "t.injuries")).alias("p"))
    name = F.coalesce(F.nullif(F.col("t.alias"), F.lit("")), F.col("t.abbreviation"))
    game = F.coalesce(F.nullif(F.col("p.injury.status"), F.lit("")), F.col("p.status"))
    return r.select(
        "season", "week", canonical_name(name, aliases).alias("team_id"), F.col("t.id").alias("provider_team_id"), F.col("t.market").alias("team_market"), F.col("t.name").alias("team_name"),
        F.col("p.id").alias("player_id"), F.col("p.name").alias("player_name"), F.col("p.jersey").alias("jersey"), F.col("p.position").alias("position"), F.col("p.injury.primary").alias("injury"),
        labels.practice(F.col("p.injury.practice.status")).alias("practice_status"), labels.status(game).alias("game_status"),
        F.try_to_timestamp("p.injury.status_date").alias("reported_at"), F.try_to_timestamp("p.injury.estimated_return_date").alias("expected_back_at"),
    )
