"""Overlapping populations in one expand, paired scores, and what each unit weighs, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger

ROWS = [(1, 2020, 1, 0.7, 0.6, 1, False), (2, 2020, 2, 0.2, 0.4, 0, False), (3, 2020, 3, 0.5, None, 1, False), (4, 2021, 1, 0.9, 0.5, 0, False), (5, 2021, 1, 0.5, 0.5, None, True), (6, 2021, 2, None, 0.5, 1, False), (7, None, None, 0.5, 0.5, 1, False)]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, "game long, season int, week int, p double, q double, y int, push boolean")
    where = {"first": F.col("week") == 1, "early": F.col("week") <= 2, "late": F.col("week") >= 3}
    return ledger.ledger(df, where, {"spread": ("p", "q", F.col("y"), F.col("push"))}, ["game", "season"])


def test_a_row_per_population(rows):
    got = sorted((r.population, r.game, r.match, r.excluded, r.y) for r in rows.collect())
    assert got == sorted([("first", 1, "MATCHED", False, 1.0), ("early", 1, "MATCHED", False, 1.0), ("early", 2, "MATCHED", False, 0.0), ("late", 3, "NO_QUOTE", False, 1.0), ("first", 4, "MATCHED", False, 0.0), ("early", 4, "MATCHED", False, 0.0),
                          ("first", 5, "MATCHED", True, None), ("early", 5, "MATCHED", True, None), ("early", 6, "MATCHED", False, 1.0)])


def test_paired_scores(rows):
    got = {r.population: r for r in ledger.paired_scores(rows).collect()}
    e = got["early"]
    assert (e["rows"], e.excluded, e.unmatched, e.graded) == (5, 1, 0, 3)
    model, market = [-math.log(0.7), -math.log(0.8), -math.log(0.1)], [-math.log(0.6), -math.log(0.6), -math.log(0.5)]
    d = [b - a for a, b in zip(model, market)]
    mean = sum(d) / 3
    assert e.gain == pytest.approx(mean) and e.model_log_loss == pytest.approx(sum(model) / 3)
    assert e.gain_se == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in d) / 2 / 3)) and e.better == pytest.approx(2 / 3)
    assert e.model_ece == pytest.approx((0.3 + 0.2 + 0.9) / 3) and e.market_brier == pytest.approx((0.16 + 0.16 + 0.25) / 3)
    assert (got["late"].graded, got["late"].unmatched, got["late"].gain) == (0, 1, None)


def test_totals_less_a_unit(rows):
    got = {(r.population, r.season): r for r in ledger.left_out(rows, "season").collect()}
    assert got["early", 2020].others == 1 and got["early", 2020].gain_without == pytest.approx(math.log(0.1) - math.log(0.5))
    assert got["first", 2021].gain_without == pytest.approx(math.log(0.7) - math.log(0.6))
