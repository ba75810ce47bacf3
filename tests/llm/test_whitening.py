"""Whitening against numpy on the whole table, and awkward vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening
from tidemark.llm.queries import op11_whitening, table

SF = "/root/testdata/sf0.001"


def by_numpy(vectors, components):
    """n, {place: deviation}, whitened columns, explained of the vectors (lists of floats), in plain steps."""
    x = [[math.floor(256 * float(np.float64(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit)]
    c = np.array([[v - s[i] / n for i, v in enumerate(r)] for r in fit])
    e, q = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[: min(components, d)]
    white = (np.array([[v - s[i] / n for i, v in enumerate(r)] for r in x]) @ q[:, order]) / np.sqrt(e[order])
    return n, [sum((n * v - s[i]) ** 2 for i, v in enumerate(r)) for r in x], white, e[order] / e.sum()


def test_query_equals_numpy(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    n, deviation, white, explained = by_numpy([r.embedding for r in rows], 4)
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = op11_whitening(spark, SF).collect()
    assert len(got) == 4 * len(rows)
    column = np.zeros_like(white)
    for r in got:
        i = at[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation[i])
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        column[i, r.component - 1] = r.whitened
    for k in range(4):  # one sign for all rows
        assert min(np.abs(column[:, k] - white[:, k]).max(), np.abs(column[:, k] + white[:, k]).max()) < 1e-8


def test_awkward_vectors(spark):
    good = [[0.5, -1.0, 2.0], [0.25, 3.0, -0.001], [-0.0, 0.0, 1.0], [7.0, 1.5, 1.0]]
    rows = [(1, good[0]), (1, good[0]), (None, good[1]), (4, good[2]), (5, good[3]), (5, good[3]), (6, None), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [1.0, float("inf"), 1.0]), (10, [1.0, 2.0]), (11, [])]
    df = spark.createDataFrame([(*r, 1.5, 2) for r in rows], "vec_id long, embedding array<float>, whitened double, n int")
    got = whitening.whitened_components(df, 4).collect()
    kept = [r for r in rows if r[0] in (1, None, 4, 5)]
    n, deviation, white, explained = by_numpy([r[1] for r in kept], 3)
    assert n == 4 and len(got) == 3 * len(kept)  # no more components than dimensions
    for k in range(1, 4):
        mine = sorted((r.vec_id or 0, r.deviation, round(abs(r.whitened), 9)) for r in got if r.component == k)
        assert mine == sorted((i or 0, t, round(abs(w), 9)) for (i, _), t, w in zip(kept, deviation, white[:, k - 1]))
    assert sorted({r.explained for r in got}, reverse=True) == pytest.approx(list(explained))


def test_equal_vectors_have_no_components(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened_components(df).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, 0.0, None)}
    assert whitening.whitened_components(df.where("false")).count() == 0
    assert whitening.whitened_components(df.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0


def test_sums_stay_exact_beyond_64_bits(spark):
    big = [[2.0**50, 1.0], [2.0**50 + 2.0**10, -3.0], [-(2.0**49), 0.5]] * 3
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    table_, model = whitening.whiten(df, components=2)
    x = [[math.floor(256 * c) for c in v] for v in big]
    fit = set(map(tuple, x))
    s = [sum(c) for c in zip(*fit)]
    assert (model.n, model.sums) == (3, s)
    assert {r.vec_id: int(r.deviation) for r in table_.collect()} == {i: sum((3 * v - t) ** 2 for v, t in zip(r, s)) for i, r in enumerate(x)}


def test_parts_merge_alike(spark):
    """Many partitions and one give the same sums and, up to rounding, the same components."""
    rows = table(spark, SF, "embeddings")
    one, many = whitening.whiten(rows.coalesce(1))[1], whitening.whiten(rows.repartition(13))[1]
    assert one.sums == many.sums
    assert np.allclose(np.abs(one.components), np.abs(many.components), atol=1e-9)
