"""Iterative fits per group, in numpy within a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scans


def elo(games: DataFrame, group: str, order: str, winner: str, loser: str, k: float = 20.0) -> DataFrame:
    """Final ratings (group, side, rating) after all games in order; games without two sides are left out."""
    rows = scans.elo_rows(games.select(group, order, winner, loser).dropna(subset=[winner, loser]), group, [order], winner, loser, k)
    place = F.struct(order, winner, loser)
    sides = rows.select(group, place.alias("_at"), F.explode(F.array(*[F.struct(F.col(c).alias("side"), F.col(f"{n}_after").alias("rating")) for c, n in ((winner, "winner"), (loser, "loser"))])).alias("s"))
    return sides.groupBy(group, F.col("s.side").alias("side")).agg(F.max_by("s.rating", "_at").alias("rating"))


def ridge(df: DataFrame, inputs: list[str], target: str, penalty: float) -> DataFrame:
    """Ridge weights (term, weight) from the cross products, which Spark sums; only they reach one task."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in inputs]]
    rows = df.dropna(subset=[*inputs, target])
    sums = rows.agg(*[F.sum(a * b).alias(f"c{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j], *[F.sum(a * F.col(target)).alias(f"y{i}") for i, a in enumerate(x)])

    n = len(x)

    def solve(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
                w = np.linalg.solve(m + penalty * np.diag([0.0] + [1.0] * (n - 1)) + 1e-9 * np.eye(n), np.array([r[f"y{i}"] or 0.0 for i in range(n)]))
                yield pd.DataFrame({"term": ["intercept", *inputs], "weight": w})

    return sums.mapInPandas(solve, "term string, weight double")
