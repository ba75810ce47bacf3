"""Sums and last values over a key's earlier rows, without a pair join and without one task per key.

A key's rows are cut into stretches of their order (days, or runs of a number). Rows are summed within a stretch, the
stretches' own totals are summed in turn, and the two meet again by (key, stretch): a key with a third of all rows is
spread over as many tasks as it has stretches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000_000


def as_number(df: DataFrame, column: str) -> Column:
    """A time as microseconds, a number as it is."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def joined_same(left: DataFrame, right: DataFrame, names: Sequence[str], mark: str) -> DataFrame:
    """left with right's other columns, by names that may be null; right has a row per names."""
    on = [F.col(n).eqNullSafe(F.col(mark + n)) for n in names]
    return left.join(right.withColumnsRenamed({n: mark + n for n in names}), on, "left").drop(*[mark + n for n in names])


def running(df: DataFrame, key: Sequence[str], order: Sequence[str], amounts: Sequence[str], stretch: Column, inclusive: bool = False) -> DataFrame:
    """df with before_<amount>: the sum of the amount over the key's earlier rows (0 for the first), or `inclusive` through the row.

    `order` should be total within a key; `stretch` is a column that never falls along it. Nulls count as 0; rows whose
    key is null are a key. An empty table gives an empty result.
    """
    rows = df.withColumn("_stretch", stretch)
    at = [*key, "_stretch"]
    sums = rows.groupBy(*at).agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    earlier = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*at, *[F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_carry_{a}") for a in amounts])
    own = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = joined_same(rows.withColumns({f"before_{a}": F.coalesce(F.sum(a).over(own), F.lit(0)) for a in amounts}), carry, at, "_of_")
    return out.withColumns({f"before_{a}": F.col(f"before_{a}") + F.col(f"_carry_{a}") for a in amounts}).drop("_stretch", *[f"_carry_{a}" for a in amounts])


def last_before(left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, columns: Mapping[str, str], *, strict: bool = False, ties: Sequence[str] = (), width: float = DAY) -> DataFrame:
    """left with columns of right's last row of the same key at or before (`strict`: before) left's time; null if there is none.

    columns: new names and right's own. Rows of right at one time rank by `ties`, the greatest last. A left row with a
    null key or time finds nothing; right rows with such are never found. Each row of left stays one row. Both tables
    are put in one order and the last value is carried on, in stretches of `width` (microseconds, or right's number).
    """
    value = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    r = right.select(*key, as_number(right, right_time).alias("_t"), value.alias("_value"), F.struct(F.lit(0), *ties).alias("_tie")).dropna(subset=[*key, "_t"])
    r = r.withColumn("_stretch", F.floor(F.col("_t") / width))
    le = left.select(*key, as_number(left, left_time).alias("_t"), F.struct("*").alias("_row")).withColumn("_stretch", F.floor(F.col("_t") / width))
    at = [*key, "_stretch"]
    both = r.select(*at, "_t", F.lit(1 if strict else 0).alias("_side"), "_tie", "_value", F.lit(None).cast(le.schema["_row"].dataType).alias("_row"))
    both = both.unionByName(le.select(*at, "_t", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"), "_row"))
    own = Window.partitionBy(*at).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_found", F.last("_value", ignorenulls=True).over(own)).where("_row IS NOT NULL AND _t IS NOT NULL").select(*at, "_row", "_found")
    ends = r.groupBy(*at).agg(F.max_by("_value", F.struct("_t", "_tie")).alias("_end"))
    seen = le.select(*at).dropna().distinct()
    earlier = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = seen.join(ends, at, "full").withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    out = joined_same(met, carry, at, "_of_").select("_row", F.coalesce("_found", "_carry").alias("_found"))
    out = out.unionByName(le.where("_t IS NULL").select("_row", F.lit(None).cast(r.schema["_value"].dataType).alias("_found")))
    return out.select("_row.*", "_found.*")


def sums_before(snapshots: DataFrame, history: DataFrame, key: Sequence[str], day: str, history_day: str, sums: Mapping[str, Column], width: float = 30 * DAY) -> DataFrame:
    """snapshots with sums over the history of strictly earlier days, of the same key; 0 where there is none.

    sums: new names and aggregates that add up (sums or counts). History is summed by day, the days are summed up once,
    and every snapshot reads the last of them: no pairs of days.
    """
    h = history.groupBy(*key, F.col(history_day).alias("_day")).agg(*[c.alias(f"_{n}") for n, c in sums.items()])
    h = running(h, key, ["_day"], [f"_{n}" for n in sums], F.floor(as_number(h, "_day") / width), inclusive=True)
    out = last_before(snapshots, h, key, day, "_day", {n: f"before__{n}" for n in sums}, strict=True, width=width)
    return out.fillna(0, list(sums))


def fading_sums(df: DataFrame, key: Sequence[str], order: Sequence[str], fade: str, amounts: Sequence[str], inclusive: bool = True) -> DataFrame:
    """df with faded_<amount>: the sum of the amount over the key's rows through this one (or only those before), each
    times 2^(its fade - this row's).

    `fade` is a number that never falls along the order. Sums are made in stretches of 64 of it, where no power
    overflows; of what came before, only the stretch just before is over a double's precision, and it is carried in.
    """
    at = [*key, "_stretch"]
    rows = df.withColumn("_stretch", F.floor(F.col(fade) / 64))
    rows = rows.withColumns({f"_up_{a}": F.coalesce(F.col(a).cast("double"), F.lit(0.0)) * F.pow(F.lit(2.0), F.col(fade) - F.col("_stretch") * 64) for a in amounts})
    ends = rows.groupBy(*at).agg(*[(F.sum(f"_up_{a}") * 2.0**-64).alias(f"_end_{a}") for a in amounts]).withColumn("_stretch", F.col("_stretch") + 1)
    own = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = joined_same(rows.withColumns({f"faded_{a}": F.coalesce(F.sum(f"_up_{a}").over(own), F.lit(0.0)) for a in amounts}), ends, at, "_of_")
    down = F.pow(F.lit(2.0), F.col("_stretch") * 64 - F.col(fade))
    out = out.withColumns({f"faded_{a}": (F.col(f"faded_{a}") + F.coalesce(f"_end_{a}", F.lit(0.0))) * down for a in amounts})
    return out.drop("_stretch", *[f"_{w}_{a}" for a in amounts for w in ("up", "end")])


def fading_mean(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, half_life: float, name: str) -> DataFrame:
    """Adds the exponentially weighted mean of a key's earlier rows, null before the first value; NaN counts as null.

    The weight of what was seen halves every `half_life` rows, fading over nulls too, and a new value takes the rest. It
    solves m = c m' + (1 - c) x as a fading sum, in the product of the c so far.
    """
    a = 1 - 0.5 ** (1 / half_life)
    w = Window.partitionBy(*key).orderBy(*order)
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.withColumn("_x", x).withColumn("_i", F.row_number().over(w))
    seen = F.max(F.when(F.col("_x").isNotNull(), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    left = F.pow(F.lit(1 - a), F.col("_i") - F.col("_seen"))
    rows = rows.withColumn("_seen", seen).withColumn("_c", F.when(F.col("_seen").isNull(), 0.0).otherwise(left / (left + a)))
    rows = rows.withColumn("_fade", F.sum(F.when(F.col("_x").isNotNull() & (F.col("_c") > 0), -F.log2("_c")).otherwise(0.0)).over(w))
    rows = rows.withColumn("_part", (1 - F.col("_c")) * F.col("_x"))
    rows = fading_sums(rows, key, ["_i"], "_fade", ["_part"])
    return rows.withColumn(name, F.when(F.col("_seen").isNotNull(), F.lag("faded__part").over(w))).select(*df.columns, name)
