"""Prefix sums, as-of joins and fading means against plain loops, one key with most of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import prefix, scans

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("strict", [False, True])
def test_last_before_with_one_hot_key(spark, strict):
    r = random.Random(5)
    key = lambda: None if (k := r.random()) < 0.02 else "hot" if k < 0.8 else f"k{r.randrange(6)}"
    time = lambda: None if r.random() < 0.02 else T0 + timedelta(hours=r.randrange(24 * 40))
    left = [(i, key(), time()) for i in range(400)]
    right = [(i, key(), time(), r.randrange(3)) for i in range(500)]
    le = spark.createDataFrame(left, "id long, k string, t timestamp").withColumn("value", F.lit("mine"))
    ri = spark.createDataFrame(right, "id long, k string, at timestamp, tie int").repartition(7)
    got = prefix.last_before(le, ri, ["k"], "t", "at", {"match": "id", "match_at": "at"}, strict=strict, ties=["tie", "id"])
    assert got.columns == ["id", "k", "t", "value", "match", "match_at"]
    want = {}
    for i, k, t in left:
        may = [(at, tie, j) for j, kk, at, tie in right if k is not None and kk == k and t is not None and at is not None and (at < t or (at == t and not strict))]
        want[i] = max(may)[2] if may else None
    assert {x.id: x.match for x in got.collect()} == want and got.count() == len(left)
    assert got.where("match_at > t").count() == 0


def test_hot_key_is_spread_over_its_stretches(spark):
    rows = spark.range(1000).selectExpr("'hot' AS k", "timestamp_micros(id * 3600000000) AS t", "id")
    plan = prefix.last_before(rows, rows, ["k"], "t", "t", {"m": "id"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Cartesian" not in plan
    sizes = rows.groupBy("k", F.floor(F.unix_micros("t") / prefix.DAY)).count().agg(F.max("count")).first()[0]
    assert sizes == 24  # so many rows of the key share a task at most


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    for inclusive in (False, True):
        got = {x.i: x.before_v for x in prefix.running(df, ["k"], ["i"], ["v"], F.floor(F.col("i") / 17), inclusive).collect()}
        assert got == {i: sum(v or 0 for k2, j, v in rows if k2 == k and (j < i or inclusive and j == i)) for k, i, _ in rows}
    assert prefix.running(df.limit(0), ["k"], ["i"], ["v"], F.col("i")).count() == 0


def test_sums_before_read_no_later_day(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), T0 + timedelta(days=r.randrange(80)), r.randrange(9)) for _ in range(400)]
    h = spark.createDataFrame(rows, "k string, d timestamp, v long")
    s = spark.createDataFrame([(k, T0 + timedelta(days=d)) for k in "abc" for d in range(0, 90, 7)], "k string, d timestamp")
    got = {(x.k, x.d): (x.n, x.v) for x in prefix.sums_before(s, h, ["k"], "d", "d", {"n": F.count("*"), "v": F.sum("v")}).collect()}
    assert got == {(k, d): (sum(k2 == k and d2 < d for k2, d2, _ in rows), sum(v for k2, d2, v in rows if k2 == k and d2 < d)) for k, d in got}
    late = h.withColumn("v", F.when(F.col("d") >= T0 + timedelta(days=40), 1000).otherwise(F.col("v")))
    again = {(x.k, x.d): x.v for x in prefix.sums_before(s, late, ["k"], "d", "d", {"v": F.sum("v")}).collect()}
    assert all(again[k] == got[k][1] for k in got if k[1] <= T0 + timedelta(days=40))


@pytest.mark.parametrize("half_life", [0.5, 4.0, 60.0])
def test_fading_mean_equals_the_fold(spark, half_life):
    r = random.Random(3)
    rows = [(f"k{i % 2}", i, None if r.random() < 0.15 else r.uniform(-50, 50)) for i in range(3000)] + [("n", 1, None), ("n", 2, 3.0), ("n", 3, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    new = {(x.k, x.i): x.m for x in prefix.fading_mean(df, ["k"], ["i"], "v", half_life, "m").collect()}
    old = {(x.k, x.i): x.m for x in scans.ewm_rows(df, ["k"], ["i"], "v", half_life, "m").collect()}
    assert new.keys() == old.keys()
    for k, m in old.items():
        assert (m is None) == (new[k] is None) and (m is None or abs(m - new[k]) < 1e-9)


def test_fading_mean_takes_nan_for_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 5.0), (4, 0.0)], "i long, v double").withColumn("k", F.lit(1))
    got = [x.m for x in prefix.fading_mean(df, ["k"], ["i"], "v", 1.0, "m").orderBy("i").collect()]
    assert got[:3] == [None, 1.0, 1.0] and got[3] == pytest.approx((0.25 * 1.0 + 0.5 * 5.0) / 0.75)
