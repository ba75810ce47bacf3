"""Ratings before each snapshot against a fit by row."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits
from tidemark.plans.catalog import QUERIES

PRIOR = {"prior_mean": 0.1, "prior_sd": 0.4, "prior_exposure": 20.0}


def plays(n=160):
    r = np.random.default_rng(5)
    out = []
    for i in range(n):
        a, b = r.choice(6, 2, replace=False)
        day = dt.date(2020, 9, 1) + dt.timedelta(days=int(r.integers(0, 900)))
        out.append((day, day.year, f"t{a}", f"t{b}", float(r.normal() + a - b), float(r.integers(0, 30))))
    return [*out, (dt.date(2020, 9, 9), 2020, "t1", "t2", None, 5.0), (dt.date(2020, 9, 9), 2020, None, "t2", 1.0, 5.0)]


def by_row(rows, day, season, sides):
    rows = [r for r in rows if None not in r and r[0] < day and 0 <= season - r[1] < 3 and r[5] > 0]
    y, w = np.array([r[4] for r in rows]), np.array([r[5] * 0.55 ** (season - r[1]) for r in rows])
    x = np.zeros((len(rows), 2 * len(sides)))
    for i, r in enumerate(rows):
        x[i, sides.index(r[2])] = x[i, len(sides) + sides.index(r[3])] = 1
    g = w.sum() / (w.sum() + 20 * 8)
    mean = 0.1 + g * ((w @ y) / w.sum() - 0.1)
    c = np.linalg.solve(x.T @ (w[:, None] * x) + 30 * np.eye(x.shape[1]), x.T @ (w * (y - mean)))
    a, b = c[: len(sides)], c[len(sides) :]
    mean, c = mean + a.mean() + b.mean(), np.concatenate((a - a.mean(), b - b.mean()))
    e = y - mean - x @ c
    var = np.average((e - np.average(e, weights=w)) ** 2, weights=w)
    return mean, np.sqrt(g * var + (1 - g) * 0.16), c, x.T @ w


def test_ratings_equal_a_fit_by_row(spark):
    rows, sides = plays(), [f"t{i}" for i in range(7)]  # t6 never plays
    h = spark.createDataFrame(rows, "day date, season int, a string, b string, v double, e double")
    at = [(dt.date(2021, 6, 1), 2021), (dt.date(2023, 1, 5), 2023), (dt.date(2020, 9, 1), 2020), (dt.date(2030, 1, 1), 2030)]
    s = spark.createDataFrame([*at, at[0], (None, 2020)], "day date, season int")
    got = fits.snapshot_ratings(h, s, spark.createDataFrame([(x,) for x in [*sides, None]], "x string"), "day", "season", "a", "b", "v", "e", **PRIOR).collect()
    assert len(got) == 28
    for day, season in at[:2]:
        mean, sd, c, held = by_row(rows, day, season, sides)
        mine = sorted((r for r in got if r.day == day), key=lambda r: r.side)
        assert np.allclose([r.own_effect for r in mine] + [r.other_effect for r in mine], c) and np.allclose([r.own_exposure for r in mine] + [r.other_exposure for r in mine], held)
        assert all(abs(r.league_mean - mean) < 1e-9 and abs(r.residual_sd - sd) < 1e-9 for r in mine)
        assert all(abs(r.own_reliability - r.own_exposure / (r.own_exposure + 20)) < 1e-12 for r in mine) and mine[6].own_n == 0
    for r in got:
        if r.day in (at[2][0], at[3][0]):  # nothing earlier; nothing in the last three seasons
            assert (r.league_mean, r.residual_sd, r.own_effect, r.other_n) == (0.1, 0.4, 0.0, 0)


def test_a_day_never_sees_itself_and_sides_are_bounded(spark):
    h = spark.createDataFrame([(dt.date(2021, 1, 1), 2021, "a", "b", 9.0, 50.0)] * 20, "day date, season int, a string, b string, v double, e double")
    s, sides = h.select("day", "season").limit(1), spark.createDataFrame([("a",), ("b",)], "x string")
    same = fits.snapshot_ratings(h, s, sides, "day", "season", "a", "b", "v", "e", **PRIOR).collect()
    later = fits.snapshot_ratings(h, s.withColumn("day", F.date_add("day", 1)), sides, "day", "season", "a", "b", "v", "e", **PRIOR).collect()
    assert all(r.league_mean == 0.1 for r in same) and all(r.league_mean > 5 for r in later)
    assert fits.snapshot_ratings(h.limit(0), s.limit(0), sides, "day", "season", "a", "b", "v", "e", **PRIOR).count() == 0
    with pytest.raises(ValueError):
        fits.snapshot_ratings(h, s, sides, "day", "season", "a", "b", "v", "e", most_sides=1, **PRIOR)


def test_the_query_rates_every_side_at_every_snapshot(spark):
    rows = QUERIES["snapshot_ratings"](spark, "/root/testdata/sf0.001").collect()
    days = {r.day for r in rows}
    assert rows and len(rows) == len(days) * len({r.side for r in rows})
    for d in list(days)[:5]:
        assert abs(sum(r.own_effect for r in rows if r.day == d)) < 1e-4
