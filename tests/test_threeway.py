"""Expanding three-way calibration against numpy, fold by fold, and the number of jobs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import threeway

SCHEMA = "market string, variant string, season int, game int, line double, conditional double, raw_push double, scored boolean, target int, push int, status string"


def made(seasons=5, per=90, seed=1):
    r = random.Random(seed)
    rows = []
    for market in ("moneyline", "spread", "total"):
        for s in range(seasons):
            for g in range(per):
                p = r.random()
                pushed = r.random() < 0.08
                line = r.choice([None, -3.0, 3.0, 2.5, 44.0, float(s)])
                rows.append((market, "v", 2018 + s, g, line, r.choice([p, p, p, None]) if g % 10 == 0 else p, r.choice([0.0, 0.05, 0.1, None]), not pushed, None if pushed else int(r.random() < 0.2 + 0.5 * p), int(pushed), "RETAIN_BASELINE_X" if market == "total" else "PASS"))
    return rows


def bucket(market, line):
    if market == "moneyline":
        return "GLOBAL"
    if line is None:
        return "MISSING"
    if abs(line - round(line)) > 1e-9:
        return "NO_PUSH"
    return f"INT_{round(abs(line) if market == 'spread' else line)}"


def curve(x, y, lam):
    w = np.zeros(2)
    d = np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ w))
        w = w + np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.diag([0, lam]), d.T @ (y - p) - lam * np.array([0, w[1]]))
    return w


def by_numpy(rows):
    clip = lambda v, a, b: min(max(v, a), b)
    logit = lambda p: math.log(clip(p, 1e-6, 1 - 1e-6) / (1 - clip(p, 1e-6, 1 - 1e-6)))
    out = {}
    for market in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == market]
        for season in {r[2] for r in mine}:
            train = [r for r in mine if r[2] < season]
            fit = [r for r in train if r[7] and r[5] is not None and r[8] in (0, 1)]
            w = curve(np.array([logit(r[5]) for r in fit]), np.array([r[8] for r in fit]), 5.0) if len(fit) >= 100 and len({r[8] for r in fit}) == 2 else None
            raw = lambda r: clip(r[6] or 0.0, 0, 1)
            rate = (sum(r[9] for r in train) + 0.5) / (len(train) + 1)
            for r in (r for r in mine if r[2] == season):
                b = bucket(market, r[4])
                p, q, method = r[5], r[6] or 0.0, "expanding_prior_seasons_only"
                if r[10].startswith("RETAIN"):
                    method = "baseline_retained_no_calibration"
                elif not train:
                    method = "identity_no_prior_oof"
                else:
                    at = [t for t in train if bucket(market, t[4]) == b]
                    if b == "NO_PUSH":
                        scale = 0.0
                    elif at:
                        scale = (sum(t[9] for t in at) + 40 * rate) / (len(at) + 40) / max(np.mean([raw(t) for t in at]), 1e-6)
                    else:
                        scale = rate / max(np.mean([raw(t) for t in train]), 1e-6)
                    q = clip(raw(r) * scale, 0, 0.25)
                    if p is not None:
                        p = clip(p, 1e-6, 1 - 1e-6) if w is None else clip(1 / (1 + math.exp(-(w[0] + w[1] * logit(p)))), 1e-6, 1 - 1e-6)
                out[r[0], r[2], r[3]] = (None, q, None, None, method) if p is None else ((1 - q) * (1 - p), q, (1 - q) * p, p, method)
    return out


ARGS = dict(market="market", season="season", line="line", conditional="conditional", raw_push="raw_push", scored="scored", target="target", push="push", status="status")


def test_every_fold_equals_numpy(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.market, r.season, r.game): r for r in threeway.three_way(df, ["market", "variant"], **ARGS).collect()}
    want = by_numpy(rows)
    assert got.keys() == want.keys()
    for k, (lower, push, upper, conditional, method) in want.items():
        r = got[k]
        assert r.calibration_method == method
        for c, v in (("lower", lower), ("push", push), ("upper", upper), ("conditional", conditional)):
            assert r[f"calibrated_{c}"] == (None if v is None else pytest.approx(v, abs=1e-8)), (k, c)


def test_later_seasons_change_nothing(spark):
    df = spark.createDataFrame(made(4), SCHEMA)
    late = df.withColumn("target", F.when(F.col("season") >= 2020, 1 - F.col("target")).otherwise(F.col("target"))).withColumn("push", F.when(F.col("season") >= 2020, 1).otherwise(F.col("push")))
    cols = ["market", "season", "game", "calibrated_push", "calibrated_upper"]
    one, other = (sorted(map(str, threeway.three_way(d, ["market", "variant"], **ARGS).where("season <= 2020").select(*cols).collect())) for d in (df, late))
    assert one == other


def test_jobs_do_not_grow_with_seasons(spark):
    def jobs(seasons):
        name = f"threeway-{seasons}"
        spark.sparkContext.setJobGroup(name, name)
        rows = spark.createDataFrame([(s, (i % 17 - 8) / 4, int(i % 3 == 0)) for s in range(seasons) for i in range(120)], "season int, x double, y int").withColumn("g", F.lit("all"))
        curves = threeway.expanding_curves(rows, ["g"], "season", "x", "y", 5.0).collect()
        assert sum(c.slope is not None for c in curves) == seasons - 1
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setJobGroup("tests", "tests")
        return n

    assert jobs(12) <= jobs(3) + 6  # a step more or less, not four times as many
