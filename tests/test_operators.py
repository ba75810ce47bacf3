"""Operators on small tables with awkward rows."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import consensus, joins, pricing, priors, windows
from tidemark.sources import tables
from tidemark.streaming import consensus as streams


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("american, decimal, implied", [(150, 2.5, 0.4), (-200, 1.5, 2 / 3), (100, 2.0, 0.5), (0, None, None), (None, None, None)])
def test_prices(spark, american, decimal, implied):
    c = F.lit(american).cast("double")
    assert one(spark, S.american_to_decimal(c)) == decimal
    assert one(spark, S.american_to_implied(c)) == (None if implied is None else pytest.approx(implied))
    if decimal:
        assert one(spark, S.decimal_to_american(F.lit(decimal))) == pytest.approx(american)


@pytest.mark.parametrize("z", [-4.0, -1.0, 0.0, 0.3, 2.5])
def test_normal_cdf(spark, z):
    assert one(spark, S.normal_cdf(F.lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / 2**0.5)), abs=2e-7)


def test_coercions_and_labels(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("inf",)], "s string")
    assert [r.v for r in df.select(S.number("s").alias("v")).collect()] == [1.5, None, None, None, None]
    df = spark.createDataFrame([("Yes",), ("0",), (None,), ("TRUE ",)], "s string")
    assert [r.v for r in df.select(S.flag("s").alias("v")).collect()] == [True, False, False, True]
    df = spark.createDataFrame([(2.0,), (-1.0,), (0.0,), (1e-10,), (float("nan"),), (float("inf"),), (None,)], "e double")
    assert [r.v for r in df.select(S.side_label("e").alias("v")).collect()] == [1, 0, None, None, None, None, None]
    assert one(spark, S.canonical_name(F.lit(" st. Louis--rams "), {"ST LOUIS RAMS": "LA RAMS"})) == "LA RAMS"
    assert one(spark, S.canonical_name(F.lit("..."))) is None


def test_own_row_is_never_in_its_features(spark):
    rows = [("a", 2020, i, float(v)) for i, v in enumerate([1, 5, 2, 8, 3])] + [("b", 2020, 0, None), ("b", 2021, 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, season int, i int, x double")
    f = lambda d: {(r.k, r.i): (r.x_all_mean, r.x_last4_n, r.x_season_n) for r in windows.prior_features(d, ["k"], ["i"], ["x"], "season").collect()}
    base, changed = f(df), f(df.withColumn("x", F.when(F.col("i") == 4, 1e9).otherwise(F.col("x"))))
    assert base == changed
    assert base["a", 0] == (None, 0, 0) and base["a", 4] == (4.0, 4, 4) and base["b", 1] == (None, 0, 0)


def test_ewm_is_that_of_pandas(spark):
    x = [None, 3.0, None, None, 5.0, 1.0, None, 2.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, i int, x double")
    got = [r.y for r in windows.ewm_prior(df, ["k"], ["i"], "x", 4.0, "y").orderBy("i").collect()]
    want = pd.Series(x, dtype=float).ewm(halflife=4, adjust=False, ignore_na=False).mean().shift(1).tolist()
    for g, w in zip(got, want):
        assert (g is None and math.isnan(w)) or g == pytest.approx(w)


def test_nearest_within(spark):
    ts = "to_timestamp_ntz(t) t"
    left = spark.createDataFrame([(1, "k", "2024-01-01 10:00:00"), (2, "k", "2024-01-02 10:00:00"), (3, "z", "2024-01-01 10:00:00"), (4, None, "2024-01-01 10:00:00"), (5, "m", "2024-01-01 10:00:00")], "id int, k string, t string").selectExpr("id", "k", ts)
    right = spark.createDataFrame([(10, "k", "2024-01-01 12:00:00"), (11, "k", "2024-01-01 08:00:00"), (12, "m", "2024-01-01 10:30:00")], "rid int, k string, t string").selectExpr("rid", "k", "to_timestamp_ntz(t) rt")
    got = {r.id: (r.match_id, r.candidates, r.status) for r in joins.nearest_within(left, right, ["k"], "id", "rid", "t", "rt", 6 * 3600).collect()}
    assert got == {1: (10, 2, "matched_nearest_ambiguous"), 2: (None, 0, "outside_tolerance"), 3: (None, 0, "key_not_found"), 4: (None, 0, "key_not_found"), 5: (12, 1, "matched")}


def test_outliers_and_freshness(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10.0, 10.5, 9.5, 10.2, 50.0])] + [("b", 9 + i, 1.0) for i in range(4)] + [("b", 20, 3.0), ("c", 30, 1.0), ("c", 31, None)], "g string, i int, x double")
    assert {r.i for r in consensus.mad_outliers(df, ["g"], "x", 3.5, 1.0).where("is_outlier = 1").collect()} == {4, 20}
    df = spark.createDataFrame([(1, 5, 1.0), (2, 500, None), (3, -1, 0.1), (4, None, 9.0)], "i int, age int, x double")
    got = {r.i: (r.reasons, r.eligible) for r in consensus.freshness(df, "age", "x", 60, 0.5, 5.0).collect()}
    assert got == {1: ("", 1), 2: ("MISSING|STALE", 0), 3: ("FUTURE|TOO_LOW", 0), 4: ("TOO_HIGH", 0)}


def test_priors_and_stakes(spark):
    df = spark.createDataFrame([("u", "a", 1.0, 10.0), ("u", "b", 3.0, 1.0), ("v", "c", 5.0, 4.0), ("v", "d", None, 4.0)], "g string, e string, x double, n double")
    got = {r.e: r for r in priors.empirical_bayes(df, "e", ["g"], "x", "n", 10.0, 0.5).collect()}
    assert got["c"].prior_mean == 5.0 and got["c"].between == 0.5 and got["a"].between == 2.0
    assert abs(got["b"].prior_mean - got["b"].group_mean) < abs(got["a"].prior_mean - got["a"].group_mean) * 10
    mix = spark.createDataFrame([("k", 0.5, 0.0, 1.0), ("k", 0.5, 2.0, 1.0), ("k", 0.0, 99.0, 1.0)], "k string, p double, m double, s double")
    r = priors.mixture(mix, ["k"], "p", "m", "s").first()
    assert (r.mixture_mean, r.mixture_variance, r.entropy) == (1.0, 2.0, pytest.approx(math.log(2)))
    assert one(spark, pricing.kelly(F.lit(0.6), F.lit(2.0))) == pytest.approx(0.2)
    assert one(spark, pricing.kelly(F.lit(0.6), F.lit(1.0))) == 0
    assert one(spark, pricing.kelly(F.lit(0.6), F.lit(None).cast("double"))) == 0
    caps = windows.capped_share(spark.createDataFrame([("w", 3.0), ("w", 5.0), ("x", 1.0), ("y", 0.0)], "w string, s double"), ["w"], "s", 4.0, "c")
    assert sorted(r.c for r in caps.collect()) == [0.0, 1.0, 1.5, 2.5]
    grid = pricing.margin_grid(spark.createDataFrame([(1, 3.0)], "i int, m double"), ["i"], "m", 10.0, -60, 60)
    assert grid.agg(F.sum("p")).first()[0] == pytest.approx(1)


def test_quotes_json(spark):
    good = '[{"id":"e","commence_time":"2024-09-08T17:00:00Z","home_team":"H","away_team":"A","bookmakers":[{"key":"b","markets":[{"key":"h2h","outcomes":[{"name":"H","price":1.5},{"name":"A","price":2.6},{"name":"Draw","price":9}]}]},{"key":"c"}]}]'
    df = spark.createDataFrame([(good,), ("[]",), ("broken",), (None,)], "payload string")
    rows = tables.flatten_quotes(df).collect()
    assert [(r.book, r.side, r.price) for r in rows if r.side] == [("b", "home", 1.5), ("b", "away", 2.6), ("b", "draw", 9.0)]
    assert sum(r.book == "c" for r in rows) == 1


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, s string")
    tables.write_once(df, f"{tmp_path}/t.parquet")
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_once(df, f"{tmp_path}/t.parquet")
    df.write.json(f"{tmp_path}/t.jsonl")
    df.write.option("header", True).csv(f"{tmp_path}/t.csv")
    for end in ("parquet", "jsonl", "csv"):
        assert tables.read_tabular(spark, f"{tmp_path}/t.{end}").count() == 2
    report = {(r.problem, r.column): r.n for r in tables.contract_report(df.union(df), ["i", "s", "z"], ["i"], {"i": [1]}).collect()}
    assert report == {("missing_column", "z"): 1, ("null_value", "i"): 0, ("null_value", "s"): 2, ("not_allowed", "i"): 2, ("surplus_rows", "i"): 2}


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    args = ("ts", "event_type", "user_id", "value", "1 day", "1 hour")
    live = streams.drain(streams.windowed(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), *args), "live_consensus", f"{tmp_path}/ck")
    key = lambda df: sorted((r.start, r.event_type, r.n, r.first_source, r.last_source, round(r.mean_value, 6)) for r in df.collect())
    assert key(live) == key(streams.windowed(src, *args))
