"""Gates on schemas, folds over long keys, and rules for feeds."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import evaluation, gates, games, pricing, scans


def test_columns_are_gated(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, None)], "id int, x double, empty double")
    assert gates.distinct_columns(["a", "b"], ["b", "c", "a"]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        gates.allowed_columns(["x", "score_post"], [], ["_post$"])
    with pytest.raises(ValueError):
        gates.first_column(df, ["y", "z"])
    assert df.select(gates.first_column(df, ["y"], 7).alias("v")).first().v == 7
    assert gates.one_role_each(["line_a", "line_b", "x"], {"anchor": ["line_a"], "leak": ["line_b"]}, "^line", ["leak"]) == ["line_a", "x"]
    with pytest.raises(ValueError):
        gates.one_role_each(["line_a"], {"anchor": [], "leak": []}, "^line", [])
    with pytest.raises(ValueError):
        gates.feature_matrix(df, ["id"], "x", ["empty"])
    assert gates.feature_matrix(df, ["id"], "x", ["id"]).columns == ["id", "x"]
    assert gates.feature_matrix(df.limit(0), ["id"], "x", ["empty"]).count() == 0


def test_an_unknown_market_fails(spark):
    df = spark.createDataFrame([("h2h",), ("props",)], "m string")
    assert [r.m for r in df.select(labels.market("m").alias("m")).collect()] == ["moneyline", None]
    with pytest.raises(Exception, match="unknown market"):
        df.select(labels.market("m", strict=True)).collect()


def test_season_lists(spark):
    df = spark.createDataFrame([("2020-2022",), ("2021, 2024",), (None,)], "s string")
    assert [r.y for r in df.select(labels.seasons("s").alias("y")).collect()] == [[2020, 2021, 2022], [2021, 2024], None]


def test_shown_numbers(spark):
    df = spark.createDataFrame([(1234.5,), (None,), (math.inf,), (math.nan,)], "x double")
    assert [r.x for r in df.select(labels.shown("x", 2).alias("x")).collect()] == ["1234.50", "—", "—", "—"]


def test_live_finality_assumes_nothing(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, at(0), "Final", at(3), None), (2, at(0), "", None, None), (3, at(0), "Final", None, at(4)), (4, at(20), "Final", at(3), None), (5, at(0), "live", at(3), None), (6, None, None, None, None), (7, at(0), "Final", at(22), None)]
    df = spark.createDataFrame(rows, "id int, ko timestamp, st string, done timestamp, play timestamp")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    got = {r.id: (r.finality, r.verified, r.assumed) for r in gates.finality(df, now, "ko", "st", "done", "play").collect()}
    assert got == {
        1: ("FINAL_BEFORE_ASOF", True, False), 2: ("UNKNOWN_FINALITY", False, False), 3: ("FINAL_BEFORE_ASOF", True, False), 4: ("POST_ASOF_KICKOFF", False, False),
        5: ("EXPLICIT_NON_FINAL", False, False), 6: ("UNKNOWN_FINALITY", False, False), 7: ("IN_PROGRESS_AT_ASOF", False, False),
    }
    again = {r.id: (r.finality, r.assumed) for r in gates.finality(df, now, "ko", "st", "done", "play", replay=True).collect()}
    assert again[2] == ("HISTORICAL_AVAILABILITY_ASSUMPTION", True) and again[7] == ("IN_PROGRESS_AT_ASOF", True)


def test_folds_pass_from_batch_to_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, None if i % 9 == 4 else float((i * 7 + k) % 5 - 2)) for k in range(3) for i in range(100)]
        df = spark.createDataFrame(rows, "k int, i int, r double")
        got = {(r.k, r.i): (r.cusum_up, r.cusum_down, r.alarm) for r in scans.cusum_rows(df, ["k"], ["i"], "r", 0.1, 4.0).collect()}
        for k in range(3):
            up = down = 0.0
            for _, i, r in [x for x in rows if x[0] == k]:
                up, down = max(0.0, up + (r or 0.0) - 0.1), max(0.0, down - (r or 0.0) - 0.1)
                assert got[k, i] == (pytest.approx(up), pytest.approx(down), up > 4 or down > 4)
                if up > 4 or down > 4:
                    up = down = 0.0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_drift_needs_enough_rows(spark):
    df = spark.createDataFrame([("m", i, 1.0, 0) for i in range(40)], "m string, i int, p double, y int")
    got = evaluation.drift(df, ["m"], ["i"], "p", "y").orderBy("i").collect()
    assert all(r.triggered for r in got) and not any(r.drift_alarm for r in got[:31])
    assert any(r.drift_alarm for r in got[31:])


def test_folded_tails_sum_to_one(spark):
    df = spark.createDataFrame([(1, 70.0), (2, -80.0), (3, 0.0)], "id int, m double")
    got = pricing.folded_grid(df, ["id"], "m", 13.5).groupBy("id").agg(F.sum("p").alias("s"), F.max_by("p", "margin").alias("end")).orderBy("id").collect()
    assert all(abs(r.s - 1) < 1e-9 for r in got)
    assert got[0].end > 0.3


def test_the_lower_of_two_centers(spark):
    df = spark.createDataFrame([(1.5,), (9.0,), (None,)], "s double")
    centers = spark.createDataFrame([(1.0,), (2.0,), (None,)], "c double")
    assert [r.c for r in pricing.nearest_center(df, "s", centers, "c").collect()] == [1.0, 2.0, None]


def test_plays_with_few_columns(spark):
    df = spark.createDataFrame([("g", "A", "B", 1, "0.5"), ("g", "B", "A", 1, None), ("g", None, "A", 1, "2")], "game_id string, posteam string, defteam string, rush_attempt int, epa string")
    got = {r.team_id: r for r in games.team_games(df).collect()}
    assert set(got) == {"A", "B"}
    assert got["A"].offense_epa_per_play == 0.5 and got["B"].defense_allowed_epa_per_play == 0.5 and got["B"].offense_epa_per_play is None
    assert got["A"].punt_attempts == 0 and got["A"].opponent_punt_attempts == 0 and got["A"].offense_completion_rate is None
    assert games.team_games(df.limit(0)).count() == 0
