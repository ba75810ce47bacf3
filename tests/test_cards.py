"""Betting cards, scores against the market and availability reports on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, pricing
from tidemark.sources import injuries


def test_a_cards_three_ways_sum_to_one(spark):
    g = spark.createDataFrame([(1, "A", "B", -3.0, 44.5), (2, "C", "D", None, 41.0), (3, "E", "F", 0.0, None)], "game_id int, home_team string, away_team string, home_spread double, total_line double")
    rows = {(r.game_id, r.market): r for r in pricing.card(g, ["game_id"], 13.0, 10.0, {"total": "READY"}).collect()}
    assert len(rows) == 9 and rows[1, "ats"].matchup == "B @ A" and rows[1, "total"].readiness == "READY" and rows[1, "ats"].readiness == "RETAIN_BASELINE"
    for market in ("ats", "total"):
        r = rows[1, market]
        assert abs(r.win + r.push + r.other - 1) < 1e-9 and r.edge == 0
    assert rows[1, "ats"].push > 0 and rows[1, "total"].push == 0
    m = rows[1, "moneyline"]
    assert m.push == 0 and abs(m.win + m.other + m.tie - 1) < 1e-9 and m.win > 0.5 and m.home_margin == 3
    assert rows[2, "ats"].win is None and rows[2, "ats"].stake == 0 and rows[3, "total"].push is None and abs(rows[2, "total"].win - rows[2, "total"].other) < 1e-6
    assert pricing.card(g.limit(0), ["game_id"], 13.0, 10.0, {}).count() == 0


def test_a_quote_and_a_model_replace_the_lines_own_chance(spark):
    g = spark.createDataFrame([(1, "A", "B", -3.0, 44.5, 0.6, 0.5, 2.1)], "game_id int, home_team string, away_team string, home_spread double, total_line double, model_total double, market_total double, odds_total double")
    r = pricing.card(g, ["game_id"], 13.0, 10.0, {}).where("market = 'total'").first()
    assert (r.model, r.fair, r.odds) == (0.6, 0.5, 2.1) and abs(r.edge - 0.1) < 1e-12 and abs(r.stake - (0.6 * 1.1 - 0.4) / 1.1) < 1e-12


def test_scores_against_the_market(spark):
    df = spark.createDataFrame([(2020, 1, 0.8, 0.6), (2020, 0, 0.4, 0.3), (2021, 1, 0.5, 0.5), (2021, None, 0.5, 0.5), (2021, 1, None, 0.5), (None, 1, 0.9, 0.1)], "season int, y int, p double, q double")
    out = {r.season: r for r in evaluation.against_market(df, {"m": ("y", "p", "q")}, "season").collect()}
    assert {k: v.n for k, v in out.items()} == {None: 3, 2020: 2, 2021: 1}
    assert abs(out[2020].model_brier - 0.1) < 1e-12 and abs(out[2020].brier_gain - 0.025) < 1e-12 and out[2020].better == 0.5 and out[2021].better == 0
    assert evaluation.against_market(df.limit(0), {"m": ("y", "p", "q")}, "season").count() == 0
    d = spark.createDataFrame([(1, 3.0, 2.0, -6.0), (1, None, 2.0, 1.0), (2, -1.0, 4.0, 2.0)], "season int, won double, guess double, spread double")
    m = {r.season: r for r in evaluation.margins_against_market(d, "won", "guess", "spread", "season").collect()}
    assert (m[1].n, m[1].model_mae, m[1].market_mae, m[1].gain) == (1, 1.0, 3.0, 2.0) and m[None].n == 2 and m[2].better == 0


def test_a_report_with_odd_headers(spark):
    raw = spark.createDataFrame([("kc", "P", "Did Not Participate", "2025-09-03"), ("SF ", None, None, "soon")], ["Team Alias", "Name", "Practice-Status", "report date"])
    a, b = injuries.report(raw, 2025, 1, {"KC": "KAN"}).orderBy("team_id").collect()
    assert (a.team_id, a.practice_status, a.game_status, a.week, a.position) == ("KAN", "DNP", "NO_DESIGNATION", "1", None) and a.reported_at.day == 3
    assert (b.team_id, b.practice_status, b.player_name, b.reported_at) == ("SF", "NOT_LISTED", None, None)
    assert injuries.report(raw.limit(0), 2025, 1).count() == 0
    with pytest.raises(Exception, match="no known team"):
        injuries.report(raw, 2025, 1, teams=["SF"]).collect()


def test_nested_teams_and_broken_payloads(spark):
    top = '{"season": {"year": 2024}, "week": {"sequence": 2, "teams": [{"alias": "X", "players": [{"id": "9"}]}]}, "teams": [{"alias": "", "abbreviation": "kc", "injuries": [{"id": "1", "status": "Active", "injury": {"status": "Out", "status_date": "2024-09-02", "practice": {"status": "dnp"}}}]}]}'
    deep = '{"league": {"teams": [{"alias": "SF", "players": [{"id": "2"}]}]}, "week": {"teams": [{"alias": "LA", "players": [{"id": "3"}, {"id": "4"}]}, {"alias": "NY"}]}}'
    df = spark.createDataFrame([(top,), (deep,), ("{",), ("{}",), (None,)], "payload string")
    rows = {r.player_id: r for r in injuries.flatten(df).collect()}
    assert sorted(rows) == ["1", "2", "3", "4"]
    assert (rows["1"].team_id, rows["1"].season, rows["1"].week, rows["1"].practice_status, rows["1"].game_status) == ("KC", 2024, "2", "DNP", "OUT")
    assert (rows["2"].team_id, rows["2"].season, rows["2"].game_status, rows["3"].team_id) == ("SF", None, "NO_DESIGNATION", "LA")
    assert injuries.flatten(df.where(F.lit(False))).count() == 0
