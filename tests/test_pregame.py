"""The pregame fold against a plain loop that emits each row before it updates any state."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pregame

COLUMNS = "game long, league string, season int, game_index int, home string, away string, home_score int, away_score int, neutral boolean, playoff boolean, home_spread double, total_line double"


def made(seed=2, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        h, a = r.sample(["hot", *[f"t{k}" for k in range(7)]], 2)
        if r.random() < 0.4:
            h, a = "hot", a if a != "hot" else h
        played = r.random() > 0.03
        rows.append((i, r.choice("xy"), 2000 + i * 4 // n, i * 7 % 1000, h, a, r.randrange(0, 50) if played else None, r.randrange(0, 50) if played else None, r.random() < 0.1, r.random() < 0.1, r.choice([None, -3.0, 2.5]), r.choice([None, 44.0])))
    return rows


def loop(rows, alpha=0.18, prior=8.0):
    out = {}
    for league in {x[1] for x in rows}:
        rating, team, meet = {}, defaultdict(lambda: dict(n=0, h=[0, 0, 0], a=[0, 0, 0], f=22.0, g=22.0, m=0.0)), defaultdict(list)
        total, last = [0, 0.0, 0.0], None
        for x in sorted((x for x in rows if x[1] == league), key=lambda x: (x[2], x[3], x[0])):
            game, _, season, _, home, away, hs, aws, neutral, playoff = x[:10]
            if last is not None and season != last:
                rating = {k: 2 / 3 * v + 1 / 3 * 1505 for k, v in rating.items()}
            last = season
            ra, rb = rating.get(home, 1500.0), rating.get(away, 1500.0)
            gap = (ra - rb + (0 if neutral else 55)) * (1.2 if playoff else 1)
            p = 1 / (1 + 10 ** (-gap / 400))
            lh, la = (total[1] / total[0], total[2] / total[0]) if total[0] else (22.0, 20.5)
            ratio = lambda s, k, base: (s[k] + prior * base) / (s[0] + prior) / base if base > 0 else 1.0
            attack = lambda t: (ratio(t["h"], 1, lh) + ratio(t["a"], 1, la)) / 2
            weak = lambda t: (ratio(t["h"], 2, la) + ratio(t["a"], 2, lh)) / 2
            t, u, pair = team[home], team[away], meet[frozenset((home, away))]
            out[game] = dict(home_rating=ra, away_rating=rb, rating_gap=gap, home_chance=p, expected_margin=gap / 25, league_home=lh, league_away=la, home_attack=attack(t), away_attack=attack(u), home_weakness=weak(t), away_weakness=weak(u),
                             expected_home=lh * attack(t) * weak(u), expected_away=la * attack(u) * weak(t), meetings=len(pair), meetings_total=sum(pair) / len(pair) if pair else None, home_games=t["n"], away_games=u["n"],
                             home_fading_for=t["f"], home_fading_against=t["g"], home_fading_margin=t["m"], away_fading_for=u["f"], away_fading_against=u["g"], away_fading_margin=u["m"])
            if hs is None:
                continue
            for s, k, a, b in ((t, "h", hs, aws), (u, "a", aws, hs)):
                s["n"] += 1
                s[k] = [s[k][0] + 1, s[k][1] + a, s[k][2] + b]
                s["f"], s["g"], s["m"] = (alpha * v + (1 - alpha) * w for v, w in ((a, s["f"]), (b, s["g"]), (a - b, s["m"])))
            total = [total[0] + 1, total[1] + hs, total[2] + aws]
            pair.append(hs + aws)
            d = hs - aws
            actual, own = (1, gap) if d > 0 else (0, -gap) if d < 0 else (0.5, 0)
            delta = 20 * (actual - p) * math.log(abs(d) + 1) * 2.2 / max(0.001 * own + 2.2, 1e-9)
            rating[home], rating[away] = ra + delta, rb - delta
    return out


def test_every_row_is_emitted_before_the_update(spark):
    rows = made()
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    got = {r.game: r for r in pregame.pregame(df, ["league"]).collect()}
    want = loop(rows)
    assert got.keys() == want.keys()
    for g, w in want.items():
        for c, v in w.items():
            assert got[g][c] == pytest.approx(v, abs=1e-7), (g, c)
    for x in rows:
        r = got[x[0]]
        if x[6] is None:
            assert r.home_win is None and r.home_margin is None and r.ats_push == 0
        else:
            m = x[6] - x[7]
            assert r.home_win == (0.5 if m == 0 else float(m > 0)) and r.total_points == x[6] + x[7]
            assert r.home_cover == (None if x[10] is None or m + x[10] == 0 else float(m + x[10] > 0))
            assert r.total_push == int(x[11] is not None and x[6] + x[7] == x[11])


def test_own_and_later_scores_change_nothing(spark):
    rows = made(5, 120)
    df = spark.createDataFrame(rows, COLUMNS)
    cut = 60
    late = df.withColumns({c: F.when(F.col("game") >= cut, 70).otherwise(F.col(c)).cast("int") for c in ("home_score", "away_score")})
    order = {x[0]: (x[1], x[2], x[3], x[0]) for x in rows}
    first = {lg: min(order[g] for g in order if g >= cut and order[g][0] == lg) for lg in "xy"}
    one, other = ({r.game: r for r in pregame.pregame(d, ["league"]).select("game", "home_rating", "league_home", "home_attack", "away_fading_margin", "meetings_total").collect()} for d in (df, late))
    same = [g for g in order if order[g] <= first[order[g][0]]]
    assert len(same) > 30 and all(one[g] == other[g] for g in same)


def test_state_goes_on_without_history(spark):
    """The ratings at the end are those of a fold of one league; a league without games keeps its ratings."""
    rows = [(1, "x", 2000, 1, "a", "b", 20, 10, False, False, None, None), (2, "y", 2000, 1, "a", "b", 3, 3, True, False, None, None), (3, "x", 2001, 1, "b", "c", 7, 0, False, True, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    _, state = pregame.season_ratings(df, ["league"])
    got = {(r.league, r.side): r.rating for r in state.collect()}
    assert got.keys() == {("x", "a"), ("x", "b"), ("x", "c"), ("y", "a"), ("y", "b")}
    assert got["y", "a"] == got["y", "b"] == 1500.0  # even game on neutral ground, and no season after it
    assert sum(got[k] for k in got if k[0] == "x") == pytest.approx(2 / 3 * 3000 + 2 / 3 * 1505 + 1500)
    empty, _ = pregame.season_ratings(df.limit(0), ["league"])
    assert empty.count() == 0


def test_elo_before_games_reads_all_events(spark):
    """The registered query against a plain loop over the whole table."""
    from tidemark.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    events = sorted((r.event_type, r.ts, r.event_id, r.user_id) for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    pairs = [(a[0], a[2], a[3], b[3]) for a, b in zip(events, events[1:]) if a[0] == b[0] and a[3] != b[3]]
    rating, want = {}, {}
    for kind, event, a, b in sorted(pairs, key=lambda x: (x[0], x[1], x[2], x[3])):
        ra, rb = rating.get((kind, a), 1500.0), rating.get((kind, b), 1500.0)
        want[event] = (ra, rb)
        gain = 20 * (1 - 1 / (1 + 10 ** ((rb - ra) / 400)))
        rating[kind, a], rating[kind, b] = ra + gain, rb - gain
    got = {r.event_id: (r.winner_before, r.loser_before) for r in QUERIES["elo_before_games"](spark, sf).collect()}
    assert len(want) > 900 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_a_season_is_spread_over_its_days(spark, monkeypatch):
    """A league's and a side's running sums are cut by day of the season, so that no task holds a whole season."""
    rows = [(i, 0, 2024, i // 5, i % 4, (i + 1) % 4, 20 + i % 7, 17 + i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "game long, league int, season int, game_index int, home int, away int, home_score int, away_score int")
    seen, run = [], pregame.running

    def counted(d, key, order, amounts, stretch, *args):
        seen.append((list(key), d.groupBy(*key, stretch.alias("_s")).count().groupBy().max("count").first()[0]))
        return run(d, key, order, amounts, stretch, *args)

    monkeypatch.setattr(pregame, "running", counted)
    got = {r.game: r for r in pregame.pregame_states(df, ["league"]).collect()}
    most = {tuple(k): n for k, n in seen}
    assert most["league",] == 5 and most["league", "side"] <= 5
    for g in (5, 23, 49):
        assert got[g].league_home == pytest.approx(sum(x[6] for x in rows[:g]) / g)
