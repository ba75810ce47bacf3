"""Totals in order over a whole table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, order: str, amounts: Sequence[str], parts: int = 256) -> DataFrame:
    """Adds below_<amount>: the sum of the amount over rows with a smaller value of `order`.

    `order` is numeric, not null and unique. Values are cut at `parts` approximate quantiles; the sums of the parts are
    small enough to rank in one task, and rows are ranked within their part.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_part", part)
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sums = rows.groupBy("_part").agg(*[F.sum(a).alias(a) for a in amounts])
    sums = sums.select("_part", *[F.coalesce(F.sum(a).over(w), F.lit(0)).alias(f"_before_{a}") for a in amounts])
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(sums), "_part")  # at most `parts` rows
    return out.withColumns({f"below_{a}": F.col(f"_before_{a}") + F.coalesce(F.sum(a).over(within), F.lit(0)) for a in amounts}).select(*df.columns, *[f"below_{a}" for a in amounts])
