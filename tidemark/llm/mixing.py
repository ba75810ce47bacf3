"""A mix of sources by weighted fair queueing, in DataFrame functions alone.

Every source is a queue of its documents in a shuffled order, twice over (or as often as `repeats` says). A document's
virtual finish time is the number of words that its source has served through it, divided by the source's weight.
All documents of all queues are range-sorted by that time and the mix is cut where the budget is used up. A source
that runs dry leaves its share to the others by weight, so the cut falls where the targets are met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import tasks, written
from tidemark.llm.ordering import AT, PART, in_order, part_offsets, with_ranks, with_totals

#: A word of a text: a run without ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, repeats: int, weights: Sequence[float]) -> DataFrame:
    """source, source_size, weight, target for (source, source_size); a null source is a source, the last one.

    Sources in order of code points take the weights in turn. Targets share `share` times all sizes by weight, but stop
    at `repeats` times the source's size, and what is over is shared again. The level (target per weight) is where
    sources, by the level at which they run dry, stop running dry; sums go by the offsets of a range sort.
    """
    ranked = with_ranks(in_order(sizes, [F.asc_nulls_last("source")], "sources"), "place")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    rows = ranked.select("source", "source_size", w.alias("weight"), (F.col("source_size") * repeats).alias("most"))
    rows = in_order(rows, [F.col("most") / F.col("weight"), F.asc_nulls_last("source")], "dry")
    total = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, all_weight = share * (total["size"] or 0), total["weight"] or 1.0
    level = (F.lit(budget) - F.col("below_most")) / (F.lit(all_weight) - F.col("below_weight"))
    reach = with_totals(rows, ["most", "weight"]).withColumn("level", level)
    level = reach.where(F.col("most") / F.col("weight") > F.col("level")).agg(F.min_by("level", F.struct(F.col("most") / F.col("weight"), F.col("below_weight")))).first()[0]
    target = F.col("most").cast("double") if level is None else F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level)))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def queued(rows: DataFrame, sources: DataFrame, repeats: int, lanes: int) -> DataFrame:
    """Packets of the queues: the columns of both tables with `served` (words of the source through the packet), `words`
    and `finish`.

    A source's rows are dealt to lanes by their place in the shuffle, so that a large source is summed by many tasks.
    A document that is being served as its source meets its target is queued as two packets, up to there and beyond.
    """
    lane = F.shiftright(F.shiftright("place", 28) * lanes, 32).cast("int")  # places have 60 bits
    dealt = rows.withColumn("lane", lane)
    small = dealt.groupBy("source", "lane").agg(F.sum("size").alias("lane_size"))
    before = F.sum("lane_size").over(Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))  # `lanes` rows a source at most
    small = small.select(F.col("source").alias("own"), F.col("lane").alias("own_lane"), F.coalesce(before, F.lit(0)).alias("lane_before"))
    small = small.join(sources, F.col("own").eqNullSafe(F.col("source"))).drop("source")
    within = F.sum("size").over(Window.partitionBy("source", "lane").orderBy("place", "row"))
    summed = dealt.withColumn("through", within).join(small, F.col("source").eqNullSafe(F.col("own")) & (F.col("lane") == F.col("own_lane")))
    twice = summed.select("row", "doc_id", "size", "place", "source", "source_size", "weight", "target", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"), (F.col("through") + F.col("lane_before")).alias("through"))
    served = F.col("through") + F.col("turn") * F.col("source_size")
    whole = F.floor("target")
    inside = (whole > served - F.col("size")) & (whole < served)
    ends = F.when(inside, F.array(F.struct(whole.alias("served"), (whole - served + F.col("size")).alias("words")), F.struct(served.alias("served"), (served - whole).alias("words"))))
    cut = twice.select("*", F.explode(F.coalesce(ends, F.array(F.struct(served.alias("served"), F.col("size").alias("words"))))).alias("p"))
    return cut.select("row", "doc_id", "size", "place", "source", "source_size", "target", "turn", "p.served", "p.words", (F.col("p.served") / F.col("weight")).alias("finish"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 7) -> DataFrame:
    """Every document's doc_id, size, source_size, target and taken, the words that the mix takes of it.

    docs: doc_id, text, source; other columns are ignored, whatever their names. A null or empty text has no words; a
    null source is one of the sources. A source's documents are ordered by a hash of seed and doc_id (md5); rows with one
    doc_id are each their own, ordered by their place in the table. `taken` is a multiple of the size but for the document at a source's cut.
    Without words all targets are 0; an empty table gives an empty result.
    """
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), place.alias("place")), "sizes")
    sources = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, repeats, weights), "targets")
    packets = queued(rows, sources, repeats, tasks(docs))
    order = [F.col("finish"), F.asc_nulls_last("source"), F.col("turn"), F.col("place"), F.col("row"), F.col("served")]
    line = in_order(packets, order, "line")
    budget = F.lit(int(share * (rows.agg(F.sum("size")).first()[0] or 0)))
    parts = part_offsets(line, ["words"]).select(PART, "part_words", "before_words")
    line = line.join(F.broadcast(parts), PART)
    # the budget ends within one part of the sort: only its rows need a sum of their own
    whole, edge = F.col("before_words") + F.col("part_words") <= budget, F.col("before_words") < budget
    through = F.col("before_words") + F.sum("words").over(Window.partitionBy(PART).orderBy(AT))
    last = line.where(edge & ~whole).withColumn("taken", F.least(F.col("words"), F.greatest(budget - (through - F.col("words")), F.lit(0))))
    rest = line.where(~edge | whole).withColumn("taken", F.when(whole, F.col("words")).otherwise(0))
    return rest.unionByName(last).groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("row")
