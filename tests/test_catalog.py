"""Every query with SQL against DuckDB, and the others' invariants."""

from collections import Counter

import duckdb
import pytest

from tidemark.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, con, name):
    rel = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    got = Counter(tuple(plain(r[c]) for c in rel.columns) for r in df.collect())
    assert got == Counter(tuple(map(plain, r)) for r in rel.fetchall())


def test_ages_count_seconds_of_the_clock(spark, tmp_path):
    times = ["2024-01-09 23:59:59", "2024-01-09 23:59:59.000001", "2024-01-09 23:59:59.6", "2024-01-10 00:00:00", "2024-01-10 00:00:00.5", "2024-01-19 23:59:59.7", "2024-01-20 00:00:00.4", "2024-01-20 00:00:01.4"]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, TIMESTAMP '{t}' AS ts, 10.0::DOUBLE AS value" for i, t in enumerate(times)) + " UNION ALL SELECT 8, NULL, NULL"
    c = duckdb.connect()
    c.execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = {tuple(r) for r in QUERIES["freshness_reasons"](spark, str(tmp_path)).collect()}
    assert got == set(c.sql(ORACLE_SQL["freshness_reasons"]).fetchall())
    assert {r[0] for r in got if r[1] == "STALE"} == {0, 1, 2}


def test_flagship_is_there():
    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES)


def test_ridge_solves_the_normal_equations(spark):
    import numpy as np

    got = {r.term: r.weight for r in QUERIES["ridge_ratings"](spark, SF).collect()}
    pdf = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", "l_extendedprice").toPandas()
    x = np.hstack([np.ones((len(pdf), 1)), pdf.iloc[:, :3].to_numpy()])
    w = np.linalg.solve(x.T @ x + np.diag([0.0, 1, 1, 1]), x.T @ pdf.l_extendedprice.to_numpy())
    assert np.allclose([got[k] for k in ("intercept", "l_quantity", "l_discount", "l_tax")], w, rtol=1e-6)


def test_elo_keeps_the_sum(spark):
    rows = QUERIES["elo_fold"](spark, SF).collect()
    per = Counter()
    for r in rows:
        per[r.event_type] += r.rating - 1500
    assert rows and all(abs(v) < 1e-6 for v in per.values())
