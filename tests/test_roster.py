"""The ridge that chooses its penalty, against numpy with the same folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import roster

PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0)


def by_numpy(pdf, inputs):
    x = pdf[inputs].to_numpy(float)
    for j in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, j]), j])
        x[np.isnan(x[:, j]), j] = v[int(np.ceil(len(v) / 2)) - 1]
    y, fold = pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)

    def solve(a, b, penalty):
        m = np.column_stack([np.ones(len(a)), a])
        return np.linalg.solve(m.T @ m + penalty * np.diag([0] + [1] * a.shape[1]), m.T @ b)

    losses = {}
    for p in PENALTIES:
        e = 0.0
        for f in set(fold):
            w = solve(z[fold != f], y[fold != f], p)
            e += ((y[fold == f] - w[0] - z[fold == f] @ w[1:]) ** 2).sum()
        losses[p] = e / len(y)
    best = min(losses, key=losses.get)
    w = solve(z, y, best)
    fit = w[0] + z @ w[1:]
    return losses, best, w, fit, max(0.05, np.std(y - fit, ddof=1))


@pytest.mark.parametrize("noise, seed", [(0.1, 1), (8.0, 2)])
def test_same_choice_and_weights_as_numpy(spark, noise, seed):
    r = np.random.default_rng(seed)
    x = r.normal(100, [1, 5, 20, 2], (90, 4))
    y = x @ [0.5, 0.0, -0.1, 0.3] + r.normal(0, noise, 90)
    x[r.random(x.shape) < 0.08] = np.nan
    rows = [(i, *[None if np.isnan(v) and i % 2 else float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (999, 1.0, 2.0, 3.0, 4.0, None)], "id long, a double, b double, c double, d double, y double").repartition(4)
    model = roster.fit_ridge(df, ["a", "b", "c", "d"], "y", ["id"], PENALTIES)
    pdf = df.where("y IS NOT NULL").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5))).toPandas()
    losses, best, w, fit, sd = by_numpy(pdf, ["a", "b", "c", "d"])
    assert model.penalty == best and model.rows == 90
    assert [model.losses[p] for p in PENALTIES] == pytest.approx([losses[p] for p in PENALTIES], rel=1e-6)
    assert [model.intercept, *model.weights] == pytest.approx(list(w), rel=1e-6, abs=1e-8)
    assert model.sd == pytest.approx(sd, rel=1e-6)
    got = {q.id: q.adjustment_mean for q in roster.adjusted(df, model).collect()}
    assert [got[i] for i in pdf.id] == pytest.approx(list(fit), rel=1e-6, abs=1e-8) and got[999] is not None


def test_odd_inputs(spark):
    df = spark.createDataFrame([(i, 5.0, None, float(i)) for i in range(20)], "id long, flat double, none double, y double")
    model = roster.fit_ridge(df, ["flat", "none"], "y", ["id"])
    assert model.weights == pytest.approx([0, 0]) and model.intercept == pytest.approx(9.5)
    with pytest.raises(ValueError):
        roster.fit_ridge(df.limit(0), ["flat"], "y", ["id"])
