"""Market features as they stood at cut-offs before a start: the last quote of every source, refusals, consensus, movement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quotes_at(games: DataFrame, quotes: DataFrame, cutoffs: Mapping[str, float], *, game: str, start: str, source: str, taken: str, columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """One row per game, cut-off and source that ever quoted it: the source's last quote taken at or before the cut-off.

    cutoffs: names and minutes before the start. Adds cutoff, taken_at, lag_minutes (never below 0) and the columns;
    nulls where the source had none yet. Every quote is shuffled once, by its game, and all cut-offs are read in one
    pass: what goes on is one row per game and source.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    q = quotes.select(game, source, F.col(taken).alias("_taken"), *[F.col(c).alias(f"_c_{c}") for c in columns], *[F.col(c).alias(f"_r_{c}") for c in ties if c not in columns]).dropna(subset=[game, source])
    tie = [F.col(f"_c_{c}" if c in columns else f"_r_{c}") for c in ties]
    met = q.join(games.select(game, micros(start).alias("_start")).hint("shuffle_hash"), game).withColumn("_at", micros("_taken"))
    value = F.struct(F.col("_taken").alias("taken_at"), *[F.col(f"_c_{c}").alias(c) for c in columns])
    last = [F.max_by(value, F.when(F.col("_at") <= F.col("_start") - int(m * 60_000_000), F.struct("_at", *tie))).alias(f"_v{i}") for i, m in enumerate(cutoffs.values())]
    met = met.groupBy(game, source, "_start").agg(*last)
    cells = F.array(*[F.struct(F.lit(n).alias("cutoff"), F.timestamp_micros(F.col("_start") - int(m * 60_000_000)).alias("cutoff_at"), F.col(f"_v{i}").alias("v")) for i, (n, m) in enumerate(cutoffs.items())])
    met = met.select(game, source, F.explode(cells).alias("c")).select(game, source, "c.cutoff", "c.cutoff_at", "c.v.*")
    lag = (F.unix_micros("cutoff_at") - micros("taken_at")) / 60_000_000
    return met.withColumn("lag_minutes", lag)


def consensus_at(met: DataFrame, *, game: str, line: str, own: str, other: str, most_lag: float, least_sources: int) -> DataFrame:
    """Per game and cut-off: medians over the sources that pass, how many did, and why the row is refused if it is.

    own, other: implied probabilities of both sides, over 0. A source is refused whose quote is older than `most_lag`
    minutes, not there yet or incomplete. A row with fewer than `least_sources` has reasons and no consensus:
    stale_sources, late_sources, incomplete_sources, too_few_sources, joined by ';'.
    """
    there = F.col("taken_at").isNotNull()
    whole = (F.col(own) > 0) & (F.col(other) > 0) & F.col(line).isNotNull()
    fresh = F.col("lag_minutes") <= most_lag
    ok = F.coalesce(there & whole & fresh, F.lit(False))
    p = F.when(ok, F.col(own) / (F.col(own) + F.col(other)))
    v = F.when(ok, F.col(line))
    out = met.groupBy(game, "cutoff").agg(
        F.count("*").alias("sources"), F.count_if(ok).alias("eligible_sources"), F.count_if(there & ~fresh).alias("_stale"), F.count_if(~there).alias("_late"), F.count_if(there & fresh & ~F.coalesce(whole, F.lit(False))).alias("_open"),
        F.median(p).alias("probability"), F.stddev_pop(p).alias("probability_sd"), F.median(v).alias("line"), F.stddev_pop(v).alias("line_sd"),
        F.median(F.when(ok, F.col(own) + F.col(other) - 1)).alias("hold"), F.max(F.when(ok, F.col("lag_minutes"))).alias("lag_minutes"),
    )
    few = F.col("eligible_sources") < least_sources
    why = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in {"stale_sources": F.col("_stale") > 0, "late_sources": F.col("_late") > 0, "incomplete_sources": F.col("_open") > 0, "too_few_sources": few}.items()]))
    out = out.withColumn("reasons", F.when(few, F.array_join(why, ";")).otherwise(""))
    return out.withColumns({c: F.when(~few, F.col(c)) for c in ("probability", "probability_sd", "line", "line_sd", "hold", "lag_minutes")}).drop("_stale", "_late", "_open")


def movements(rows: DataFrame, games: DataFrame, *, game: str, closing: str, openings: Sequence[str]) -> DataFrame:
    """Every game's consensus at the closing cut-off, the first opening that has one (in the given order) and what moved.

    status: 'accepted', 'refused:<reasons>' or 'no_quotes'; a game without an opening has opening null.
    """
    fields = ("line", "line_sd", "probability", "probability_sd", "hold", "lag_minutes", "eligible_sources", "reasons")
    close = F.max(F.when(F.col("cutoff") == closing, F.struct(*fields)))
    rank = F.array_position(F.array(*map(F.lit, openings)), F.col("cutoff"))
    first = F.min(F.when((rank > 0) & F.col("probability").isNotNull(), F.struct(rank, "cutoff", "line", "probability")))
    t = games.select(game).join(rows.groupBy(game).agg(close.alias("c"), first.alias("o")), game, "left")
    status = F.when(F.col("c").isNull(), "no_quotes").when(F.col("c.reasons") != "", F.concat(F.lit("refused:"), F.col("c.reasons"))).otherwise("accepted")
    out = {f: F.col(f"c.{f}") for f in fields if f != "reasons"} | {"opening": F.col("o.cutoff"), "opening_line": F.col("o.line"), "opening_probability": F.col("o.probability")}
    out |= {"line_movement": F.col("c.line") - F.col("o.line"), "probability_movement": F.col("c.probability") - F.col("o.probability"), "status": status}
    return t.select(game, *[c.alias(n) for n, c in out.items()])


def attached(table: DataFrame, features: DataFrame, key: str, label: str = "features") -> DataFrame:
    """table with the columns of features, one to one: a key that only one side has, or has twice, fails the query.

    Columns that the table has already stay the table's.
    """
    extra = [c for c in features.columns if c not in table.columns]
    once = lambda df, c: df.groupBy(key).agg(F.first(F.struct(*c)).alias("_r"), F.count("*").alias("_n"))
    a, b = once(table, table.columns), once(features.select(key, *extra), [key, *extra])
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    fault = F.when(F.col("a._n").isNull(), "extra").when(F.col("b._n").isNull(), "missing").when((F.col("a._n") > 1) | (F.col("b._n") > 1), "duplicate")
    checked = F.when(fault.isNull(), F.col("a._r")).otherwise(F.raise_error(F.concat(F.lit(f"{label}: "), fault, F.lit(" key "), F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).cast("string"))).cast(a.schema["_r"].dataType))
    return j.select(checked.alias("_r"), F.col("b._r").alias("_f")).select("_r.*", *[F.col(f"_f.{c}") for c in extra])


def side_probability(decimal_price: Column) -> Column:
    """Implied probability of a decimal price over 1; null otherwise."""
    return F.when(decimal_price > 1, 1 / decimal_price)
