"""Fits whose sums Spark makes: the driver solves systems as large as the inputs, never as long as the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logistic(df: DataFrame, inputs: Sequence[str], y: str, l2: float = 0.0, offset: str | None = None, rounds: int = 25) -> dict[str, float]:
    """Weights of a logistic fit by Newton steps, with an optional fixed offset; the intercept bears no penalty.

    Each round is one aggregate of (inputs + 1) squared sums. Rows with nulls or a target other than 0 and 1 are left out;
    without both outcomes the result is empty, as is a fit that runs away (weights over 50: separated classes).
    """
    names = ["intercept", *inputs]
    cols = [*inputs, y, *([offset] if offset else [])]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna().where(F.col(y).isin(0.0, 1.0))
    n, up = rows.agg(F.count("*"), F.sum(y)).first()
    if not n or up in (0, n):
        return {}
    x = [F.lit(1.0), *[F.col(c) for c in inputs]]
    w = np.zeros(len(x))
    penalty = np.diag([0.0] + [l2] * len(inputs))
    for _ in range(rounds):
        eta: Column = F.col(offset) if offset else F.lit(0.0)
        for c, v in zip(x, w):
            eta = eta + c * float(v)
        p = 1 / (1 + F.exp(-eta))
        t = rows.withColumn("_p", p).withColumn("_v", F.col("_p") * (1 - F.col("_p")))
        sums = t.agg(*[F.sum((F.col(y) - F.col("_p")) * a).alias(f"g{i}") for i, a in enumerate(x)], *[F.sum(F.col("_v") * a * b).alias(f"h{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]).first()
        g = np.array([sums[f"g{i}"] for i in range(len(x))]) - penalty @ w
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))]) + penalty
        step = np.linalg.solve(h + 1e-12 * np.eye(len(x)), g)
        w = w + step
        if np.abs(w).max() > 50:
            return {}
        if np.abs(step).max() < 1e-10:
            break
    return dict(zip(names, w.tolist()))


def side_ratings(games: DataFrame, season: Sequence[str], own: str, other: str, value: str, penalty: float, least_rows: int = 10) -> DataFrame:
    """Ridge effects of both sides of a game per season: columns season, role (own or other), side, effect, n.

    Rows are summed to one per pair of sides, which holds all that the normal equations need, so a season's task sees
    pairs of sides and no games. Effects of a role are centred; the intercept bears no penalty. Seasons with fewer than
    `least_rows` games, or than sides, give nothing; rows with nulls are left out.
    """
    types = dict(games.dtypes)
    g = games.dropna(subset=[*season, own, other, value])
    pairs = g.groupBy(*season, own, other).agg(F.count("*").alias("_n"), F.sum(F.col(value).cast("double")).alias("_s"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pd.Index(sorted(pdf[own].unique())), pd.Index(sorted(pdf[other].unique()))
        n, rows = pdf["_n"].to_numpy(float), pdf["_n"].sum()
        size = len(a) + len(b)
        if rows < max(least_rows, size):
            return pd.DataFrame(columns=[*season, "role", "side", "effect", "n"])
        i, j = a.get_indexer(pdf[own]), len(a) + b.get_indexer(pdf[other])
        m, v = np.zeros((size, size)), np.zeros(size)
        for x in (i, j):
            np.add.at(v, x, pdf["_s"].to_numpy())
            for y in (i, j):
                np.add.at(m, (x, y), n)
        count = m.diagonal().copy()
        centre = count / rows
        m = m - rows * np.outer(centre, centre) + penalty * np.eye(size)
        effect = np.linalg.solve(m, v - centre * pdf["_s"].sum())
        effect[: len(a)] -= effect[: len(a)].mean()
        effect[len(a) :] -= effect[len(a) :].mean()
        out = pd.DataFrame({"role": ["own"] * len(a) + ["other"] * len(b), "side": [*a, *b], "effect": effect, "n": count.astype("int64")})
        for name, k in zip(season, key):
            out[name] = k
        return out[[*season, "role", "side", "effect", "n"]]

    schema = ", ".join([*[f"{s} {types[s]}" for s in season], "role string", f"side {types[own]}", "effect double", "n long"])
    return pairs.groupBy(*season).applyInPandas(solve, schema)


def snapshot_ratings(
    history: DataFrame, snapshots: DataFrame, sides: DataFrame, day: str, season: str, own: str, other: str, value: str, exposure: str, *, prior_mean: float, prior_sd: float, prior_exposure: float,
    penalty: float = 30.0, decay: float = 0.55, seasons: int = 3, least_rows: int = 8, league_factor: float = 8.0, least_sd: float = 0.005, most_sides: int = 2000,
) -> DataFrame:
    """Opponent-adjusted ratings as known before each snapshot: one row per snapshot and side.

    history: day, season, own, other, value, exposure; snapshots: day, season; sides: one column, all sides there are. Only
    rows of strictly earlier days and of the last `seasons` seasons count, by exposure * decay^age; those with nulls or no
    exposure don't. League mean and spread are shrunk to the priors, the effects of both roles fitted by a ridge on what
    is left, centred over all sides, and the centres go to the mean. Under `least_rows` rows effects are zero.

    History is summed to days and pairs of sides before it meets the snapshots by season, and to pairs after, so a
    snapshot's task sees pairs. The system has two rows a side: over `most_sides` sides raise ValueError.
    """
    names = [r[0] for r in sides.toDF("side").dropna().distinct().orderBy("side").limit(most_sides + 1).collect()]
    if len(names) > most_sides:
        raise ValueError(f"over {most_sides} sides: a dense system for each snapshot would be too large")
    types = dict(history.dtypes)
    v, e = F.col(value).cast("double"), F.col(exposure).cast("double")
    h = history.select(F.col(day).alias("_h"), F.col(season).cast("int").alias("_s"), F.col(own).alias("own"), F.col(other).alias("other"), v.alias("v"), e.alias("e")).dropna().where("e > 0")
    h = h.groupBy("_h", "_s", "own", "other").agg(F.count("*").alias("n"), F.sum("e").alias("w"), F.sum(F.col("e") * F.col("v")).alias("wv"), F.sum(F.col("e") * F.col("v") * F.col("v")).alias("wvv"))
    s = snapshots.select(F.col(day).alias("day"), F.col(season).cast("int").alias("season")).dropna().distinct().withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(seasons - 1))))
    j = s.join(h, (F.col("_s") == F.col("season") - F.col("age")) & (F.col("_h") < F.col("day")), "left").withColumn("k", F.pow(F.lit(decay), F.col("age")))
    pairs = j.groupBy("day", "season", "own", "other").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("k")).alias(c) for c in ("w", "wv", "wvv")])
    columns = ["day", "season", "side", "league_mean", "residual_sd", *[f"{role}_{c}" for role in ("own", "other") for c in ("effect", "exposure", "n", "reliability")]]
    index = pd.Index(names)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["own"].notna() & pdf["own"].isin(index) & pdf["other"].isin(index)]
        k, rows, total = len(index), int(pdf["n"].sum()), pdf["w"].sum()
        i, j = index.get_indexer(pdf["own"]), k + index.get_indexer(pdf["other"])
        w, wv, wvv = (pdf[c].to_numpy(float) for c in ("w", "wv", "wvv"))
        effect, held, count, mean, sd = np.zeros(2 * k), np.zeros(2 * k), np.zeros(2 * k, np.int64), prior_mean, prior_sd
        if total > 0:
            known = total / (total + prior_exposure * league_factor)
            mean = prior_mean + known * (wv.sum() / total - prior_mean)
            for x in (i, j):
                np.add.at(held, x, w)
                np.add.at(count, x, pdf["n"].to_numpy(np.int64))
            if rows >= least_rows:
                m, b = penalty * np.eye(2 * k), np.zeros(2 * k)
                for x in (i, j):
                    np.add.at(b, x, wv - mean * w)
                    for y in (i, j):
                        np.add.at(m, (x, y), w)
                effect = np.linalg.solve(m, b)
                for part in (effect[:k], effect[k:]):
                    mean += part.mean()
                    part -= part.mean()
                fit = mean + effect[i] + effect[j]
                first, second = (wv - w * fit).sum() / total, (wvv - 2 * fit * wv + w * fit**2).sum() / total
                sd = np.sqrt(known * max(0.0, second - first**2) + (1 - known) * prior_sd**2)
            sd = max(sd, least_sd)
        out = pd.DataFrame({"day": [key[0]] * k, "season": [key[1]] * k, "side": names, "league_mean": mean, "residual_sd": sd})
        for role, at in (("own", slice(0, k)), ("other", slice(k, 2 * k))):
            out[f"{role}_effect"], out[f"{role}_exposure"], out[f"{role}_n"] = effect[at], held[at], count[at]
            out[f"{role}_reliability"] = held[at] / (held[at] + prior_exposure)
        return out[columns]

    schema = ", ".join([f"day {dict(snapshots.dtypes)[day]}", "season int", f"side {types[own]}", *[f"{c} {'long' if c.endswith('_n') else 'double'}" for c in columns[3:]]])
    return pairs.groupBy("day", "season").applyInPandas(solve, schema)
