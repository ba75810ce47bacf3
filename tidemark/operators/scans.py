"""Folds along a key's rows in order, a batch at a time: a task holds a key's state, never its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Step = Callable[..., tuple]


def scan(df: DataFrame, key: Sequence[str], order: Sequence[str], inputs: Sequence[str], start: Callable[[], object], step: Step, added: dict[str, T.DataType]) -> DataFrame:
    """df with columns that a fold gives each row: `step(state, *inputs)` returns the row's values and may change the state.

    A key's rows are one task's, in order; those of a key with very many rows pass through it batch by batch. Where the
    next state needs the one before (resets, ratings) there is no way to split a key.
    """
    keys, into = list(key), [pa.float64() if isinstance(t, T.DoubleType) else pa.bool_() if isinstance(t, T.BooleanType) else pa.int64() for t in added.values()]

    def run(batches):
        now, state = None, None
        for batch in batches:
            at = batch.schema.names.index
            rows = zip(zip(*(batch.column(at(k)).to_pylist() for k in keys)), *(batch.column(at(c)).to_pylist() for c in inputs))
            out: list[tuple] = []
            for k, *values in rows:
                if k != now or state is None:
                    now, state = k, start()
                out.append(step(state, *values))
            columns = list(zip(*out)) if out else [[] for _ in into]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, into))], [*batch.schema.names, *added])

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added.items())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def cusum_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], residual: str, slack: float, limit: float) -> DataFrame:
    """Adds cusum_up, cusum_down and alarm to each row; after an alarm both sums begin again. A null or infinite residual
    counts as 0."""

    def step(s: list, r: float | None) -> tuple:
        r = float(r) if r is not None and abs(float(r)) < float("inf") else 0.0
        up, down = max(0.0, s[0] + r - slack), max(0.0, s[1] - r - slack)
        hit = up > limit or down > limit
        s[:] = (0.0, 0.0) if hit else (up, down)
        return up, down, hit

    return scan(df, key, order, [residual], lambda: [0.0, 0.0], step, {"cusum_up": T.DoubleType(), "cusum_down": T.DoubleType(), "alarm": T.BooleanType()})


def ewm_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, half_life: float, name: str) -> DataFrame:
    """Adds the exponentially weighted mean of a key's earlier rows; the weight of what was seen fades over nulls
    too, and NaN counts as null."""
    a = 1 - 0.5 ** (1 / half_life)

    def step(s: list, x: float | None) -> tuple:
        before, weight = s
        x = None if x is None or x != x else x
        if x is None:
            s[1] = weight * (1 - a)
        elif before is None:
            s[:] = (float(x), 1.0)
        else:
            w = weight * (1 - a)
            s[:] = ((w * before + a * float(x)) / (w + a), 1.0)
        return (before,)

    return scan(df, key, order, [value], lambda: [None, 1.0], step, {name: T.DoubleType()})


def elo_rows(games: DataFrame, group: str, order: Sequence[str], winner: str, loser: str, k: float = 20.0) -> DataFrame:
    """Adds winner_before, loser_before, winner_after and loser_after: ratings around each game; a rating starts at 1500.

    The state holds a rating per side of the group. A game without two sides changes nothing and has null ratings.
    """

    def step(rating: dict, a, b) -> tuple:
        if a is None or b is None:
            return None, None, None, None
        ra, rb = rating.get(a, 1500.0), rating.get(b, 1500.0)
        gain = k * (1 - 1 / (1 + 10 ** ((rb - ra) / 400)))
        rating[a], rating[b] = ra + gain, rb - gain
        return ra, rb, ra + gain, rb - gain

    names = ("winner_before", "loser_before", "winner_after", "loser_after")
    return scan(games, [group], [*order, winner, loser], [winner, loser], dict, step, dict.fromkeys(names, T.DoubleType()))
