"""Live rows against plain means over known games; what must not change them doesn't."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import games, live

T0 = datetime(2023, 12, 3, 18)
TEAMS = ["a", "b", "c", "d"]
NOW = T0 + timedelta(days=7 * 7 - 3)


def made():
    """Eight rounds of two games in two seasons, two plays a side; the game g5b is going on for good, g8 games are to come."""
    rows, plays = [], []
    for k in range(8):
        start = T0 + timedelta(days=7 * k)
        pairs = [("a", "b", "c", "d"), ("c", "a", "d", "b"), ("a", "d", "b", "c")][k % 3]
        for j in (0, 1):
            game, home, away = f"g{k}{'ab'[j]}", pairs[2 * j], pairs[2 * j + 1]
            at = start + timedelta(hours=3 * j)
            rows.append((game, 2023 if k < 4 else 2024, home, away, at.isoformat() + "Z", "IN_PROGRESS" if game == "g5b" else "FINAL", None if game == "g5b" else (at + timedelta(hours=4)).isoformat() + "Z", -2.5 + k, 40.0 + j))
            for n, (own, other) in enumerate(((home, away), (away, home))):
                for i in (0, 1):
                    plays.append((game, own, other, "pass" if i else "run", i, 1 - i, ((k * 7 + j * 5 + n * 3 + i * 11) % 13 - 6) / 10, (k + j + n + i) % 2, (at + timedelta(minutes=i)).isoformat()))
    return rows, plays


GAMES = "game_id string, season int, home_team_id string, away_team_id string, scheduled_kickoff_utc string, game_status string, completion_timestamp_utc string, home_spread double, total_line double"
PLAYS = "game_id string, posteam string, defteam string, play_type string, qb_dropback int, rush_attempt int, epa double, success int, start_time string"


@pytest.fixture(scope="module")
def tables(spark):
    rows, plays = made()
    g = spark.createDataFrame(rows, GAMES)
    return rows, plays, g.where("game_id < 'g7'"), g.where("game_id >= 'g7'"), spark.createDataFrame(plays, PLAYS)


def by_hand(rows, plays, game):
    """The features of a game from all earlier known games of its sides."""
    mean = lambda v: sum(v) / len(v) if v else None
    this = next(r for r in rows if r[0] == game)
    known = [r for r in rows if r[0] < "g7" and r[0] != "g5b"]

    def side(team):
        mine = [r for r in known if team in r[2:4]]
        own = lambda g, f: [f(p) for p in plays if p[0] == g and p[1] == team and f(p) is not None]
        met = lambda g: [p[6] for p in plays if p[0] == g and p[2] == team]
        table = [(r[1], mean(own(r[0], lambda p: p[6])), mean(own(r[0], lambda p: p[7])), mean(own(r[0], lambda p: p[6] if p[4] else None)), mean(own(r[0], lambda p: p[6] if p[5] else None)), mean(met(r[0]))) for r in mine]
        pick = {"last4": table[-4:], "season": [t for t in table if t[0] == this[1]]}
        rest = (datetime.fromisoformat(this[4][:-1]) - datetime.fromisoformat(mine[-1][4][:-1])).total_seconds() / 86400
        return {w: [mean([t[i] for t in ts]) for i in range(1, 6)] for w, ts in pick.items()}, rest

    (h, hr), (a, ar) = side(this[2]), side(this[3])
    out = {"home_spread": this[7], "total_line": this[8], "home_rest_days": hr, "away_rest_days": ar, "rest_diff": hr - ar, "home_short_week": float(hr < 6), "away_short_week": float(ar < 6)}
    for w in ("last4", "season"):
        x, y = h[w][0] - a[w][4], a[w][0] - h[w][4]
        out |= {f"epa_matchup_home_{w}_mean": x, f"epa_matchup_away_{w}_mean": y, f"epa_net_edge_{w}_mean": x - y}
        out |= {f"{n}_net_{w}_mean": h[w][i] - a[w][i] for n, i in (("success_rate", 1), ("dropback_epa", 2), ("rush_epa", 3))}
    return out


def test_features_are_means_of_known_games(tables):
    rows, plays, history, targets, p = tables
    out, status = live.live_features(history, targets, p, NOW)
    got = {r.game_id: r for r in out.collect()}
    assert out.columns == ["game_id", *live.features()] and len(live.features()) == 19
    assert got.keys() == {"g7a", "g7b"}
    for g, r in got.items():
        for c, v in by_hand(rows, plays, g).items():
            assert r[c] == pytest.approx(v, abs=1e-12), (g, c)
    s = status.first()
    assert (s.eligible_games, s.open_games, s.rows, s.unknown_games, s.nulls_rest_diff) == (13, 1, 2, 0, 0)
    assert s.plays_left_out == 4 * 3  # those of the open game and of the two to come


def test_what_must_not_change_features(tables):
    _, _, history, targets, p = tables
    first = live.live_features(history, targets, p, NOW)[1].first().snapshot
    later = F.col("game_id").isin("g5b", "g7a", "g7b")
    twisted = p.withColumns({c: F.when(later, 77).otherwise(F.col(c)).cast(k) for c, k in (("epa", "double"), ("success", "int"))})
    assert live.live_features(history, targets, twisted, NOW)[1].first().snapshot == first
    assert live.live_features(history.orderBy(F.rand(3)), targets.orderBy(F.desc("game_id")), p.orderBy(F.rand(4)), NOW)[1].first().snapshot == first
    future = history.limit(1).withColumns({"game_id": F.lit("zz"), "scheduled_kickoff_utc": F.lit("2030-01-01T00:00:00Z")})
    assert live.live_features(history.unionByName(future), targets, p, NOW)[1].first().snapshot == first
    over = history.withColumns({"game_status": F.lit("FINAL"), "completion_timestamp_utc": F.coalesce("completion_timestamp_utc", F.lit("2024-01-08T00:00:00Z"))})
    s = live.live_features(over, targets, p, NOW)[1].first()
    assert s.snapshot != first and s.eligible_games == 14


def test_rows_to_come_leave_history_as_it_is(tables):
    _, _, history, targets, p = tables
    known = live.known_games(history, NOW).where("eligible")
    keep = ["game_id", "season", "kickoff"]
    done = games.team_games(p.join(known.select("game_id"), "game_id")).select("game_id", "team_id", *live.METRICS)
    alone = live.side_sequence(done, known.select(*keep), live.METRICS)
    coming = targets.select("game_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), *[F.lit(None).cast("double").alias(m) for m in live.METRICS])
    schedule = known.select(*keep).unionByName(targets.select("game_id", "season", F.col("scheduled_kickoff_utc").cast("timestamp").alias("kickoff")))
    both = live.side_sequence(done.unionByName(coming), schedule, live.METRICS)
    assert sorted(map(str, alone.collect())) == sorted(map(str, both.where("game_id < 'g7'").collect()))
    assert both.where("game_id >= 'g7'").count() == 4


def test_replay_and_faults(tables):
    _, _, history, targets, p = tables
    bare = history.drop("game_status", "completion_timestamp_utc")
    out, status = live.live_features(bare, targets, p, NOW)
    s = status.first()
    assert (s.eligible_games, s.unknown_games, s.nulls_rest_diff, s.nulls_home_spread) == (0, 14, 2, 0)  # no evidence: lines only
    s = live.live_features(bare, targets, p, NOW, replay=True)[1].first()
    assert (s.eligible_games, s.assumed_games, s.verified_games) == (14, 14, 0)
    with pytest.raises(ValueError, match="g7a repeats"):
        live.live_features(history, targets.unionByName(targets.where("game_id = 'g7a'")), p, NOW)
    with pytest.raises(ValueError, match="starts at or before"):
        live.live_features(history, targets, p, NOW + timedelta(days=9))
    assert live.live_features(history, targets.limit(0), p, NOW)[0].count() == 0
