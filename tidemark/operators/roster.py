"""A ridge whose penalty is chosen by folds, from one pass of sums: every fold's fit is the total less the fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ridge:
    """Weights on standardised inputs, what stands for nulls, the chosen penalty, the losses of all, and the residuals' spread."""

    inputs: tuple[str, ...]
    fill: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    penalty: float
    losses: dict[float, float]
    sd: float
    rows: int


def _filled(inputs: Sequence[str], fill: dict[str, float]) -> dict[str, Column]:
    return {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(fill[c]))) for c in inputs}


def fit_ridge(df: DataFrame, inputs: Sequence[str], target: str, key: Sequence[str], penalties: Sequence[float] = (0.1, 1.0, 10.0, 100.0), folds: int = 5, least_sd: float = 0.05, accuracy: int = 10_000) -> Ridge:
    """The ridge of `target` on the inputs with the penalty of least squared error over `folds` folds by a hash of `key`.

    Rows without a target are left out; nulls and NaN of an input count as its median (of rank within 1 / accuracy), one
    without any value as 0. Inputs are standardised over all rows; the intercept bears no penalty. Of equal losses the first penalty
    wins. One pass for the medians and one for folds x inputs^2 sums, which are all that reaches the driver.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.withColumn("_y", number(target)).where("_y IS NOT NULL")
    m = rows.agg(*[F.percentile_approx(number(c), 0.5, accuracy).alias(f"m{i}") for i, c in enumerate(inputs)]).first()
    fill = {c: float(m[i]) if m[i] is not None else 0.0 for i, c in enumerate(inputs)}
    x = _filled(inputs, fill)
    t = rows.select(F.pmod(F.xxhash64(*key), F.lit(folds)).alias("_fold"), *[v.alias(f"x{i}") for i, v in enumerate(x.values())], "_y")
    z = ["1", *[f"x{i}" for i in range(len(inputs))], "_y"]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = t.groupBy("_fold").agg(*[F.sum(F.expr(f"{z[i]} * {z[j]}")).cast("double").alias(f"s{i}_{j}") for i, j in pairs]).collect()  # a row per fold
    grams = []
    for r in sums:
        g = np.zeros((len(z), len(z)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"s{i}_{j}"]
        grams.append(g)
    if not grams:
        raise ValueError("no row has a target")
    whole = np.sum(grams, axis=0)
    n, d = whole[0, 0], len(inputs)
    mean = whole[0, 1 : d + 1] / n
    var = np.diag(whole)[1 : d + 1] / n - mean**2
    scale = np.sqrt(np.where(var > 1e-12 * np.maximum(1.0, mean**2), var, 1.0))
    # sums of (1, standardised inputs, target): a linear change of the sums of the raw ones
    change = np.eye(d + 2)
    change[1 : d + 1, 1 : d + 1] = np.diag(1 / scale)
    change[1 : d + 1, 0] = -mean / scale
    grams = [change @ g @ change.T for g in grams]
    whole = change @ whole @ change.T

    def solve(g: np.ndarray, penalty: float) -> np.ndarray:
        return np.linalg.solve(g[: d + 1, : d + 1] + penalty * np.diag([0.0] + [1.0] * d), g[: d + 1, d + 1])

    def error(g: np.ndarray, w: np.ndarray) -> float:
        v = np.append(-w, 1.0)
        return float(v @ g @ v)

    usable = [g for g in grams if n - g[0, 0] > 0]
    losses = {float(p): sum(error(g, solve(whole - g, p)) for g in usable) / n for p in penalties}
    best = min(losses, key=losses.get)
    w = solve(whole, best)
    spread = np.sqrt(max(0.0, error(whole, w) - (whole[0, d + 1] - whole[0, : d + 1] @ w) ** 2 / n) / max(1.0, n - 1))
    return Ridge(tuple(inputs), fill, mean, scale, w[1:], float(w[0]), best, losses, max(float(spread), least_sd), int(n))


def adjusted(df: DataFrame, model: Ridge, name: str = "adjustment") -> DataFrame:
    """df with <name>_mean, the model's prediction, and <name>_sd."""
    x = _filled(model.inputs, model.fill)
    out = F.lit(model.intercept)
    for c, m, s, w in zip(model.inputs, model.mean, model.scale, model.weights):
        out = out + (x[c] - float(m)) / float(s) * float(w)
    return df.withColumns({f"{name}_mean": out, f"{name}_sd": F.lit(model.sd)})
