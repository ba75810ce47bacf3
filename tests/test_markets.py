"""Price, fit, selection and rank operators against brute force and on awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import prices as P
from tidemark.operators import evaluation, fits, folds, pricing, priors, resampling, walkforward
from tidemark.operators.ranks import running_totals


def test_devig_sums_to_one(spark):
    df = spark.createDataFrame([(0.55, 0.5), (0.9, 0.2), (0.3, 0.6), (None, 0.5), (1.0, 0.2)], "p double, q double")
    p, q = F.col("p"), F.col("q")
    rows = df.select((P.power_devig(p, q) + P.power_devig(q, p)).alias("a"), (P.shin_devig(p, q) + P.shin_devig(q, p)).alias("b"), P.shin_devig(p, q).alias("c")).collect()
    for r in rows[:3]:
        assert r.a == pytest.approx(1, abs=1e-9) and r.b == pytest.approx(1, abs=1e-9)
    assert rows[2].c == pytest.approx(1 / 3)  # no margin: shares
    assert rows[3].a is None and rows[4].b is None


def test_regions_and_formulas(spark):
    df = spark.createDataFrame([(2.0, -3.0), (2.0, -3.5)], "m double, l double")
    win, push, loss = P.three_regions(F.col("m") + F.col("l"), 12.0, F.col("l"))
    rows = df.select(win.alias("w"), push.alias("p"), loss.alias("x")).collect()
    assert all(r.w + r.p + r.x == pytest.approx(1) for r in rows) and rows[0].p > 0 and rows[1].p == 0
    one = spark.range(1).select(P.contest_points(F.lit(0.7), F.lit(1), F.lit(18)).alias("a"), P.margin_multiplier(F.lit(-1), F.lit(0.0)).alias("b"), P.experience(F.lit(None).cast("int")).alias("c"), P.competitive(F.lit(100), F.lit(9)).alias("d")).first()
    assert tuple(one) == (32.0, None, "unknown", False)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_totals(spark, n):
    rng = np.random.default_rng(1)
    rows = [(float(x), int(k)) for x, k in zip(rng.permutation(n), rng.integers(0, 5, n))]
    got = {r.x: r.below_k for r in running_totals(spark.createDataFrame(rows, "x double, k long"), "x", ["k"], 16).collect()}
    assert got == {x: sum(b for a, b in rows if a < x) for x, _ in rows}


def test_equal_mass_ece(spark):
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random(131), 1), rng.integers(0, 2, 131)
    df = spark.createDataFrame([(float(a), int(b), i) for i, (a, b) in enumerate(zip(p, y))], "p double, y int, i int")
    parts = np.array_split(np.argsort(p, kind="stable"), 10)
    want = sum(len(s) * abs(p[s].mean() - y[s].mean()) for s in parts) / 131
    r = evaluation.equal_mass_ece(df, "p", "y", "i").first()
    assert (r.n, r.bins) == (131, 10) and r.ece == pytest.approx(want)
    assert evaluation.equal_mass_ece(df.limit(20), "p", "y", "i").first().ece is None
    assert evaluation.equal_mass_ece(df.where("false"), "p", "y", "i").first().n == 0


def test_logistic_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(3)
    x, off = rng.normal(size=(400, 2)), rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1, -0.5] + off)))).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(o), float(t)) for a, o, t in zip(x, off, y)] + [(None, 1.0, 0.0, 1.0)], "a double, b double, o double, y double")
    w = fits.logistic(df, ["a", "b"], "y", 2.0, "o")
    v = np.array([w["intercept"], w["a"], w["b"]])
    d = np.hstack([np.ones((400, 1)), x])
    slope = d.T @ (y - 1 / (1 + np.exp(-(d @ v + off)))) - np.array([0, 2, 2]) * v
    assert np.abs(slope).max() < 1e-6
    assert fits.logistic(df.where("y = 1"), ["a"], "y") == {} == fits.logistic(df.where("false"), ["a"], "y")
    apart = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "a double, y double")
    assert fits.logistic(apart, ["a"], "y") == {}


def test_side_ratings_equal_the_ridge_over_rows(spark):
    rng = np.random.default_rng(4)
    a, b, y = rng.integers(0, 4, 200), rng.integers(0, 5, 200), rng.normal(size=200)
    df = spark.createDataFrame([(1, int(i), int(j), float(v)) for i, j, v in zip(a, b, y)] + [(2, 0, 1, 1.0), (1, None, 1, 5.0)], "s int, a int, b int, y double")
    got = {(r.role, r.side): r.effect for r in fits.side_ratings(df, ["s"], "a", "b", "y", 3.0).collect()}
    x = np.hstack([np.eye(4)[a], np.eye(5)[b]])
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + 3 * np.eye(9), xc.T @ (y - y.mean()))
    w[:4] -= w[:4].mean()
    w[4:] -= w[4:].mean()
    assert got == pytest.approx({**{("own", i): w[i] for i in range(4)}, **{("other", i): w[4 + i] for i in range(5)}})


def test_overrides_stand_and_the_rest_is_shared(spark):
    g = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.3), ("a", 3, 0.2), ("b", 1, None), ("b", 2, 0.4)], "t string, m int, p double")
    o = spark.createDataFrame([("a", 1, 0.6), ("a", 9, 0.1)], "t string, m int, p double")
    got = {(r.t, r.m): (round(r.p, 9), r.origin) for r in priors.overridden(g, o, "t", "m", "p").collect()}
    assert got == {("a", 1): (0.6, "override"), ("a", 9): (0.1, "override"), ("a", 2): (0.18, "generated"), ("a", 3): (0.12, "generated"), ("b", 1): (0.0, "generated"), ("b", 2): (0.4, "generated")}
    with pytest.raises(Exception, match="exceed 1"):
        priors.overridden(g, o.withColumn("p", F.lit(0.7)), "t", "m", "p").collect()


def test_a_season_does_not_see_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 2000 + i % 4, float(rng.normal()), int(rng.random() < 0.4)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, s int, x double, y int")
    f = lambda d: {r.i: r.p for r in walkforward.expanding(d, "s", ["x"], "y", ["i"]).collect()}
    base = f(df)
    changed = f(df.withColumn("y", F.when(F.col("s") == 2003, 1 - F.col("y")).otherwise(F.col("y"))))
    assert set(base) == {i for i, s, *_ in rows if s > 2000} and base == pytest.approx(changed)
    assert f(df.where("false")) == {}
    assert all(0 <= r.p <= 1 for r in walkforward.expanding(df, "s", ["x"], "y", ["i"], calibrate=True).collect())


def test_folds_on_small_tables(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "s int, r double")
    assert [tuple(r)[:3] for r in folds.spread_by_season(df, "s", "r", [1.0, 2.0]).orderBy("s").collect()] == [(3, 1, 2.0)]
    assert folds.spread_by_season(df.where("false"), "s", "r", [1.0]).count() == 0
    one = folds.leave_one_out(df.withColumn("k", F.lit(1)), ["k"], "s", "r").orderBy("s").collect()
    assert [(r.s, r.mean_without) for r in one] == [(1, 4.0), (3, 2.0)]


def test_bootstrap_draws_are_compared_in_compiled_code(spark):
    """Poisson counts around every step, and a plan that neither parses numbers nor loops over arrays per draw."""
    import io
    from contextlib import redirect_stdout

    at = [(f"{s + d:08x}", k + (d >= 0)) for k, s in enumerate(resampling.STEPS) for d in (-1, 0, 1)] + [("00000000", 0), ("ffffffff", 6)]
    got = spark.createDataFrame(at, "u string, want long").withColumn("k", resampling.draws_of(F.col("u"))).collect()
    assert all(r.k == r.want for r in got)
    text = io.StringIO()
    with redirect_stdout(text):
        resampling.bootstrap(spark.range(9).withColumn("v", F.lit(1.0)), "v", ["id"], 5, 0.05, 0.95).explain()
    assert "filter(" not in text.getvalue() and "conv(" not in text.getvalue()


def test_ladder_fits_one_compiled_method_and_is_dealt_out(spark):
    """Methods over 8000 bytes are interpreted; a rung's prices are those of the regions, row by row."""
    import io
    import re
    from contextlib import redirect_stdout

    from tidemark.functions.prices import three_regions

    df = spark.createDataFrame([(i, m, line) for i, (m, line) in enumerate([(0.0, 3.0), (-7.5, 2.5), (24.0, -3.0), (-24.0, 0.25), (None, 1.0), (3.0, None)])], "id int, m double, line double")
    got = pricing.ladder(df, ["id"], "m", "line", 12.75, steps=2)
    want = dict(zip(("w", "p", "l"), three_regions(F.col("m") + F.col("rung"), 12.75, F.col("rung"))))
    both = got.join(df, "id").withColumns(want)
    assert both.count() == 30 and both.where("abs(win - w) > 1e-15 OR abs(push - p) > 1e-15 OR abs(loss - l) > 1e-15 OR (win IS NULL) <> (w IS NULL)").count() == 0
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with redirect_stdout(text):
            pricing.ladder(df, ["id"], "m", "line", 12.75).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert len(sizes) == 2 and max(sizes) < 8000  # a stage on either side of the shuffle


def test_bootstrap_of_equal_values_has_no_width(spark):
    df = spark.createDataFrame([(i, i % 3, 2.0) for i in range(60)] + [(99, 0, None)], "c int, g int, v double")
    assert tuple(resampling.bootstrap(df, "v", ["c"], 20, 0.05, 0.95, ["g"]).first()) == (20, 2.0, 2.0, 2.0)
    wide = resampling.bootstrap(df.withColumn("v", F.col("c").cast("double")), "v", ["c"], 200, 0.05, 0.95).first()
    assert wide.low < wide.mean < wide.high
