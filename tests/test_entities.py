"""Snapshot priors and starter mixtures against a plain loop over all history of each snapshot."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import entities
from tidemark.operators.entities import Fading, Metric

METRICS = [Metric("epa", "plays", 0.04, 0.25, strength=30.0), Metric("rate", "throws", 0.6, 0.08, strength=20.0, low=0.4, high=0.62)]
FADING = Fading(half_life=40.0, cap=100.0, seasons=2, decay=0.6)
START = date(2020, 9, 1)


def made(seed=4, games=260):
    """(game, team, player, day, season, epa, rate, plays, throws): seasons of 40 days, gaps of 300; player p0 plays a third of all."""
    r = random.Random(seed)
    rows = []
    for g in range(games):
        season = r.randrange(4)
        day = START + timedelta(days=340 * season + r.randrange(40))
        player = "p0" if r.random() < 0.33 else f"p{r.randrange(1, 7)}"
        value = lambda: None if (x := r.random()) < 0.04 else float("nan") if x < 0.06 else r.gauss(0.1, 0.4)
        rows.append((g, f"t{r.randrange(3)}", player, day, 2020 + season, value(), value(), r.choice([0.0, 7.0, 20.0, 33.0, 150.0, None]), float(r.randrange(1, 25))))
    return rows


def loop(rows, kind, entity, season, day, m, f):
    """mean, sd, effective, weight, league mean and sd by reading all history before the day."""
    at = {"epa": 5, "rate": 6, "plays": 7, "throws": 8, "team": 1, "player": 2}
    real = lambda x: x is not None and x == x
    h = [x for x in rows if x[3] < day and 0 <= season - x[4] < f.seasons and real(x[at[m.name]]) and real(x[at[m.exposure]]) and x[at[m.exposure]] > 0]
    w = [x[at[m.exposure]] * f.decay ** (season - x[4]) for x in h]
    v = [x[at[m.name]] for x in h]
    bound = lambda x: min(max(x, -math.inf if m.low is None else m.low), math.inf if m.high is None else m.high)
    league, league_sd = m.mean, m.sd
    if h:
        mu, k = sum(a * b for a, b in zip(w, v)) / sum(w), sum(w) / (sum(w) + 8 * m.strength)
        var = sum(a * (b - mu) ** 2 for a, b in zip(w, v)) / sum(w)
        league, league_sd = m.mean + k * (mu - m.mean), max(m.least_sd, math.sqrt(k * max(var, m.least_sd**2) + (1 - k) * m.sd**2))
    league = bound(league)
    by, pairs = defaultdict(list), []
    for x in sorted(h, key=lambda x: (x[3], x[0]), reverse=True):
        by[x[at[kind]]].append(x)
    mine = []
    for name, games in by.items():
        later = 0.0
        for x in games:
            e = x[at[m.exposure]]
            weight = min(e, max(0.0, f.cap - later)) * f.decay ** (season - x[4]) * 0.5 ** (later / f.half_life)
            later += e
            if weight > 0:
                pairs.append((weight, x[at[m.name]]))
                if name == entity:
                    mine.append(pairs[-1])
    if not mine:
        return bound(league), league_sd, 0.0, 0.0, league, league_sd
    total = sum(a for a, _ in pairs)
    mu = sum(a * b for a, b in pairs) / total
    var = max(sum(a * (b - mu) ** 2 for a, b in pairs) / total, m.least_sd**2)
    n = sum(a for a, _ in mine)
    k = n / (n + m.strength)
    return bound(mu + k * (sum(a * b for a, b in mine) / n - mu)), max(m.least_sd, math.sqrt(var * (1 - k))), n, k, league, league_sd


SCHEMA = "game long, team string, player string, day date, season int, epa double, rate double, plays double, throws double"


def test_priors_equal_the_loop(spark):
    rows = made()
    games = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wanted = [(k, e, s, START + timedelta(days=340 * (s - 2020) + d)) for s in (2020, 2021, 2023, 2024) for d in (0, 1, 13, 39, 60) for k, e in (("player", "p0"), ("player", "p3"), ("player", "new"), ("team", "t1"))]
    history = entities.long_history(games, METRICS, ["player", "team"], "day", "season", ["day", "game"])
    got = entities.priors_before(history, spark.createDataFrame(wanted, "kind string, entity string, season int, day date"), METRICS, FADING).collect()
    assert len(got) == len(wanted) * len(METRICS)
    of = {m.name: m for m in METRICS}
    for r in got:
        want = loop(rows, r.kind, r.entity, r.season, r.day, of[r.metric], FADING)
        assert (r.mean, r.sd, r.effective, r.weight, r.league_mean, r.league_sd) == pytest.approx(want, abs=1e-9), (r, want)
    assert any(r.effective > 0 for r in got) and any(r.effective == 0 for r in got)


def test_the_future_changes_nothing(spark):
    rows = made(6)
    day = START + timedelta(days=340 + 20)
    games = spark.createDataFrame(rows, SCHEMA)
    late = games.withColumns({c: F.when(F.col("day") >= day, F.lit(99.0)).otherwise(F.col(c)) for c in ("epa", "rate", "plays", "throws")})
    candidates = spark.createDataFrame([(1, "t0", "p0", 0.75, day, 2021), (1, "t0", "p1", 0.5, day, 2021), (1, "t1", "p2", 1.0, day, 2021), (1, "t1", "new", None, day, 2021)], "game long, team string, player string, p double, day date, season int")
    args = dict(game="game", team="team", player="player", probability="p", day="day", season="season", order=["day", "game"])
    one = {(r.team, r.metric): r for r in entities.starter_features(games, candidates, METRICS, FADING, **args).collect()}
    other = {(r.team, r.metric): r for r in entities.starter_features(late, candidates, METRICS, FADING, **args).collect()}
    assert one == other and len(one) == 4
    r, m = one["t0", "epa"], METRICS[0]
    a, b = (loop(rows, "player", p, 2021, day, m, FADING) for p in ("p0", "p1"))
    mean = 0.6 * a[0] + 0.4 * b[0]
    assert (r.mean, r.effective, r.weight) == pytest.approx((mean, 0.6 * a[2] + 0.4 * b[2], 0.6 * a[3] + 0.4 * b[3]))
    assert r.sd == pytest.approx(max(m.least_sd, math.sqrt(0.6 * (a[1] ** 2 + a[0] ** 2) + 0.4 * (b[1] ** 2 + b[0] ** 2) - mean**2)))
    assert (r.expected, r.candidates) == ("p0", 2) and r.entropy == pytest.approx(-0.6 * math.log(0.6) - 0.4 * math.log(0.4))
    t = loop(rows, "team", "t0", 2021, day, m, FADING)
    assert (r.team_mean, r.team_sd, r.delta) == pytest.approx((t[0], max(m.least_sd, t[1]), mean - t[0]))
    with pytest.raises(Exception, match="come to 0"):
        entities.starter_features(games, candidates.withColumn("p", F.lit(0.0)), METRICS, FADING, **args).collect()


def test_no_history(spark):
    games = spark.createDataFrame([], SCHEMA)
    wanted = spark.createDataFrame([("player", "a", 2020, START)], "kind string, entity string, season int, day date")
    got = entities.priors_before(entities.long_history(games, METRICS, ["player", "team"], "day", "season", ["day", "game"]), wanted, METRICS, FADING).collect()
    assert {(r.metric, r.mean, r.sd, r.effective) for r in got} == {("epa", 0.04, 0.25, 0.0), ("rate", 0.6, 0.08, 0.0)}


def test_states_are_read_once_a_day(spark, monkeypatch):
    """An entity with many games a day has one state a day; the ledger meets entities and groups in one pass."""
    from datetime import date, timedelta

    games = spark.createDataFrame([(i, "p1", "t1", date(2024, 1, 1) + timedelta(days=i // 40), 2024, 0.1 * (i % 7), 3.0) for i in range(200)], "game long, player string, team string, day date, season int, a double, n double")
    metric = [entities.Metric("a", "n", 0.3, 0.3)]
    history = entities.long_history(games, metric, ["player", "team"], "day", "season", ["day", "game"])
    wanted = spark.createDataFrame([("player", "p1", 2024, date(2024, 1, 1) + timedelta(days=d)) for d in range(6)], "kind string, entity string, season int, day date")
    seen, read = [], entities._read

    def counted(points, *args):
        seen.append(points.count())
        return read(points, *args)

    monkeypatch.setattr(entities, "_read", counted)
    got = entities.priors_before(history, wanted, metric, entities.Fading(60.0, 150.0, 2, 0.6)).orderBy("day").collect()
    assert len(got) == 6 and [r.effective > 0 for r in got] == [False, True, True, True, True, True]
    assert len(seen) == 1 and seen[0] <= 5 + 2 * (5 + 1)  # five known states; two entities' days and their next season
