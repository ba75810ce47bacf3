"""A table in a total order over many tasks: range-sorted, written, and numbered by the offsets of its parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

PART, AT = "_part", "_at"


def in_order(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df range-sorted by `order` and written, with each row's part (_part, rising) and its place there (_at, from 0).

    Both are stored with the rows, so a task that runs again can't change them. `order` should be total: rows that tie
    in it keep together in one part, in any order.
    """
    placed = df.orderBy(*order).withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return written(placed, name)


def part_offsets(rows: DataFrame, amounts: Sequence[str] = ()) -> DataFrame:
    """A row per part of in_order's table: _part, before_rows and before_<amount>, the totals over all earlier parts,
    and part_<amount>, its own. There are as many rows as the sort had tasks, so one task adds them up."""
    sums = rows.groupBy(PART).agg(F.count("*").alias("part_rows"), *[F.coalesce(F.sum(a), F.lit(0)).alias(f"part_{a}") for a in amounts])
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("*", *[F.coalesce(F.sum(f"part_{a}").over(earlier), F.lit(0)).alias(f"before_{a}") for a in ("rows", *amounts)])


def with_ranks(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """in_order's rows with their rank from 1 on: the offset of the part and the place in it. No shuffle."""
    before = part_offsets(rows).select(PART, "before_rows")
    return rows.join(F.broadcast(before), PART).withColumn(rank, F.col("before_rows") + F.col(AT) + 1).drop(PART, AT, "before_rows")


def with_totals(rows: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """in_order's rows with below_<amount>: the sum of the amount over all rows before. A part is summed in one task."""
    before = part_offsets(rows, amounts).select(PART, *[f"before_{a}" for a in amounts])
    within = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(before), PART)
    return out.withColumns({f"below_{a}": F.col(f"before_{a}") + F.coalesce(F.sum(a).over(within), F.lit(0)) for a in amounts}).drop(PART, AT, *[f"before_{a}" for a in amounts])
