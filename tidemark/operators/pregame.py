"""Every game's features as they stood before it: sums, fading points, head to head, league means, and Elo by season.

What adds up (points, meetings, league totals, fading means) is a running or fading sum. Only the ratings need the row
before: they fold along a season, and a table of every side's rating carries them to the next, so a task holds the
games of one league's season. A game without both scores changes nothing and still has its features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.prefix import fading_sums, joined_same, running
from tidemark.operators.scans import scan
from tidemark.operators.stages import staged


@dataclass(frozen=True)
class Rating:
    """Where ratings start, what they go back to between seasons, and how a game moves them."""

    start: float = 1500.0
    mean: float = 1505.0
    keep: float = 2.0 / 3.0
    k: float = 20.0
    scale: float = 400.0
    per_point: float = 25.0
    home: float = 55.0
    playoff: float = 1.2


def _played() -> Column:
    return F.col("home_score").isNotNull() & F.col("away_score").isNotNull()


def sides(games: DataFrame, league: Sequence[str]) -> DataFrame:
    """Two rows a game: the side, the venue, and points for and against where the game has been played."""
    row = lambda side, other, venue: F.struct(F.col(side).alias("side"), F.lit(venue).alias("venue"), F.when(_played(), F.col(f"{venue}_score")).cast("double").alias("pf"), F.when(_played(), F.col(f"{other}_score")).cast("double").alias("pa"))
    return games.select("game", *league, "season", "game_index", F.explode(F.array(row("home", "away", "home"), row("away", "home", "away"))).alias("s")).select("game", *league, "season", "game_index", "s.*")


def side_states(games: DataFrame, league: Sequence[str], alpha: float = 0.18, points: float = 22.0) -> DataFrame:
    """Per game and venue, what is known of the side before: games and points by venue, and fading means of points.

    A fading mean starts at `points` (its margin at 0) and takes the share `alpha` of each game.
    """
    key = [*league, "side"]
    rows = sides(games, league)
    for v in ("home", "away"):
        at = F.col("pf").isNotNull() & (F.col("venue") == v)
        rows = rows.withColumns({f"{v}_n": at.cast("int"), f"{v}_pf": F.when(at, F.col("pf")), f"{v}_pa": F.when(at, F.col("pa"))})
    amounts = [f"{v}_{c}" for v in ("home", "away") for c in ("n", "pf", "pa")]
    order = ["season", "game_index", "game", "venue"]
    rows = staged(running(rows, key, order, amounts, F.struct(*order[:2])), "side-sums")
    step = -log2(1 - alpha)
    n = F.col("before_home_n") + F.col("before_away_n")
    own = F.col("pf").isNotNull().cast("int")
    rows = fading_sums(rows.withColumn("_fade", (n + own) * step), key, order, "_fade", ["pf", "pa"], inclusive=False)
    mean = lambda c, m0: F.col(f"faded_{c}") * F.pow(F.lit(2.0), own * step) * alpha + F.pow(F.lit(1 - alpha), n) * m0
    out = rows.withColumns({"games": n, "fading_for": mean("pf", points), "fading_against": mean("pa", points)}).withColumn("fading_margin", F.col("fading_for") - F.col("fading_against"))
    return out.select("game", "venue", *[F.col(f"before_{a}").alias(a) for a in amounts], "games", "fading_for", "fading_against", "fading_margin")


def pregame_states(games: DataFrame, league: Sequence[str] = (), alpha: float = 0.18, prior_games: float = 8.0) -> DataFrame:
    """Per game: league means, both sides' attack and weakness, expected points, head to head, games and fading means before it.

    games: game (unique), season, game_index (the order within a season), home, away, home_score, away_score and the
    columns of `league`; others are ignored. Points over the league's are shrunk by `prior_games` average games. A league
    without games has 22 points at home and 20.5 away (fixed values).
    """
    g = games.select("game", *league, "season", "game_index", "home", "away", "home_score", "away_score")
    order = ["season", "game_index", "game"]
    s = staged(side_states(g, league, alpha), "sides")
    fields = [c for c in s.columns if c not in ("game", "venue")]
    wide = s.groupBy("game").agg(*[F.max(F.when(F.col("venue") == v, F.struct(*fields))).alias(v) for v in ("home", "away")])
    ran = g.select("game", *league, *order[:2], F.least("home", "away").alias("_a"), F.greatest("home", "away").alias("_b"), _played().cast("int").alias("n"), F.when(_played(), F.col("home_score")).cast("double").alias("h"), F.when(_played(), F.col("away_score")).cast("double").alias("w"))
    ran = ran.withColumn("t", F.col("h") + F.col("w"))
    whole = running(ran, league, order, ["n", "h", "w"], F.struct(*order[:2])).select("game", *[F.col(f"before_{c}").alias(c) for c in ("n", "h", "w")])
    met = running(ran, [*league, "_a", "_b"], order, ["n", "t"], F.col("season")).select("game", F.col("before_n").alias("m"), F.col("before_t").alias("mt"))
    j = g.select("game").join(wide, "game").join(staged(whole, "league"), "game").join(staged(met, "meetings"), "game")
    home, away = F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(22.0), F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(20.5)
    j = j.withColumns({"league_home": home, "league_away": away})
    ratio = lambda who, what, n, base: F.when(F.col(base) > 0, (F.col(f"{who}.{what}") + prior_games * F.col(base)) / (F.col(f"{who}.{n}") + prior_games) / F.col(base)).otherwise(1.0)
    for who in ("home", "away"):
        attack = (ratio(who, "home_pf", "home_n", "league_home") + ratio(who, "away_pf", "away_n", "league_away")) / 2
        weak = (ratio(who, "home_pa", "home_n", "league_away") + ratio(who, "away_pa", "away_n", "league_home")) / 2
        j = j.withColumns({f"{who}_attack": attack, f"{who}_weakness": weak})
    expected = {"expected_home": F.col("league_home") * F.col("home_attack") * F.col("away_weakness"), "expected_away": F.col("league_away") * F.col("away_attack") * F.col("home_weakness")}
    each = {f"{who}_{c}": F.col(f"{who}.{c}") for who in ("home", "away") for c in ("games", "fading_for", "fading_against", "fading_margin")}
    return j.withColumns(expected).select(
        "game", "league_home", "league_away", *[f"{who}_{c}" for who in ("home", "away") for c in ("attack", "weakness")], "expected_home", "expected_away", (F.col("expected_home") + F.col("expected_away")).alias("expected_total"),
        F.col("m").alias("meetings"), F.when(F.col("m") > 0, F.col("mt") / F.col("m")).alias("meetings_total"), *[c.alias(n) for n, c in each.items()],
    )


def _season_fold(games: DataFrame, key: Sequence[str], r: Rating) -> DataFrame:
    """Ratings around each game of one season; home_start and away_start hold what the sides bring into it."""

    def step(held: dict, home, away, home_start, away_start, hs, aws, neutral, playoff) -> tuple:
        a, b = held.get(home, home_start), held.get(away, away_start)
        gap = (a - b + (0.0 if neutral else r.home)) * (r.playoff if playoff else 1.0)
        p, moved = 1.0 / (1.0 + 10.0 ** (-gap / r.scale)), 0.0
        if hs is not None and aws is not None:
            margin = float(hs) - float(aws)
            sign = (margin > 0) - (margin < 0)
            moved = r.k * ((sign + 1) / 2 - p) * log(abs(margin) + 1.0) * 2.2 / max(0.001 * sign * gap + 2.2, 1e-9)
            held[home], held[away] = a + moved, b - moved
        return a, b, gap, p, gap / r.per_point, a + moved, b - moved

    names = ("home_rating", "away_rating", "rating_gap", "home_chance", "expected_margin", "home_after", "away_after")
    inputs = ["home", "away", "home_start", "away_start", "home_score", "away_score", "neutral", "playoff"]
    return scan(games, key, ["game_index", "game"], inputs, dict, step, dict.fromkeys(names, T.DoubleType()))


def season_ratings(games: DataFrame, league: Sequence[str] = (), r: Rating = Rating()) -> tuple[DataFrame, DataFrame]:
    """(games, state): each game's ratings before it, gap, home_chance and expected_margin; and every side's rating at the end.

    games as in pregame_states, with neutral and playoff. Before a season the ratings of the leagues that play it go back towards the mean. Seasons
    run one after the other: a job folds one, a task for each league, and the ratings go on as a written table.
    """
    key = [*league] or ["_all"]
    g = games.withColumn("_all", F.lit(0)).select("game", *key, "season", "game_index", "home", "away", *[F.col(c).cast("double").alias(c) for c in ("home_score", "away_score")], *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("neutral", "playoff")])
    g = staged(g, "games")
    seasons = [x[0] for x in g.select("season").distinct().orderBy("season").collect()]
    state, done = None, None
    for season in seasons:
        now = g.where(F.col("season").eqNullSafe(F.lit(season)))
        if state is None:
            now = now.withColumns({"home_start": F.lit(r.start), "away_start": F.lit(r.start)})
        else:
            plays = now.select(*key).distinct().withColumn("_plays", F.lit(True))
            back = F.when(F.col("_plays"), r.keep * F.col("rating") + (1 - r.keep) * r.mean).otherwise(F.col("rating"))
            state = staged(joined_same(state, plays, key, "_of_").withColumn("rating", back).drop("_plays"), "ratings")
            for who in ("home", "away"):
                now = joined_same(now, state.withColumnsRenamed({"side": who, "rating": f"{who}_start"}), [*key, who], "_of_").fillna(r.start, [f"{who}_start"])
        out = staged(_season_fold(now, key, r), "season")
        last = F.struct("game_index", "game")
        after = out.select(*key, last.alias("_at"), F.explode(F.array(*[F.struct(F.col(w).alias("side"), F.col(f"{w}_after").alias("rating")) for w in ("home", "away")])).alias("s"))
        after = after.groupBy(*key, F.col("s.side").alias("side")).agg(F.max_by("s.rating", "_at").alias("rating"))
        state = after if state is None else after.unionByName(_without(state, after, [*key, "side"]))
        state = staged(state, "ratings")
        done = out if done is None else done.unionByName(out)
    keep = ("home_rating", "away_rating", "rating_gap", "home_chance", "expected_margin")
    if done is None:
        kind = dict(g.dtypes)
        return g.select("game", *[F.lit(0.0).alias(c) for c in keep]), g.select(*league, F.col("home").cast(kind["home"]).alias("side"), F.lit(0.0).alias("rating"))
    return done.select("game", *keep), state.drop("_all")


def _without(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    marked = joined_same(rows, gone.select(*key).withColumn("_gone", F.lit(True)), key, "_of_")
    return marked.where("_gone IS NULL").drop("_gone")


def outcomes() -> dict[str, Column]:
    """Targets of a played game; a margin or total on the line is a push, and a tie half a win."""
    margin, total = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    side = lambda x: F.when(x != 0, (x > 0).cast("double"))
    return {
        "home_margin": margin, "total_points": total, "home_win": F.when(margin == 0, 0.5).otherwise(side(margin)), "home_cover": side(margin + F.col("home_spread")), "ats_push": F.coalesce((margin + F.col("home_spread") == 0).cast("int"), F.lit(0)),
        "over": side(total - F.col("total_line")), "total_push": F.coalesce((total == F.col("total_line")).cast("int"), F.lit(0)),
    }


def pregame(games: DataFrame, league: Sequence[str] = (), alpha: float = 0.18, prior_games: float = 8.0, r: Rating = Rating()) -> DataFrame:
    """games with all states before each game (pregame_states and season_ratings) and its outcomes.

    games as there, with home_spread and total_line (null where unknown). Each game has one row; no column but the
    outcomes reads its own scores.
    """
    states = staged(pregame_states(games, league, alpha, prior_games), "states")
    rated, _ = season_ratings(games, league, r)
    out = games.join(states, "game").join(rated, "game")
    return out.withColumns(outcomes())
