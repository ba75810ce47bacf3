"""Resampling of documents towards a target's word n-grams, in Spark SQL's own functions.

n-grams are exploded and hashed into buckets, whose counts give a gain each; the table of gains (as many rows as
buckets at most) is broadcast to the exploded n-grams and summed per document. Gumbel noise from a hash of the id makes
the highest scores a weighted draw without replacement; they are ranked by a distributed sort and the offsets of its parts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.ordering import in_order, with_ranks

#: A word: anything but ASCII characters that are neither digits nor lower-case letters (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the whole text, A to Z lower-cased; none if null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def runs_of(words: Column, most: int) -> Column:
    """All runs of 1 to `most` consecutive words, joined by a space, repeats included."""
    out = [words]
    for n in range(2, most + 1):
        longer = F.zip_with(out[-1], F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        out.append(F.slice(longer, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))))
    return F.concat(*out)


def bucketed(rows: DataFrame, most: int, buckets: int) -> DataFrame:
    """rows with `words` exploded to a row per n-gram, with its bucket; a row without words stays once, with null."""
    keep = [c for c in rows.columns if c != "words"]
    return rows.select(*keep, F.explode_outer(runs_of(F.col("words"), most)).alias("gram")).select(*keep, (F.crc32("gram") % buckets).cast("int").alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, most: int, buckets: int) -> DataFrame:
    """bucket, gain: floored thousandfold log ratio of the target's share of a bucket to the documents', both plus one.

    Only buckets that documents have. Counts are added up before they are shuffled.
    """
    count = lambda df: bucketed(df.select(words_of(F.col("text")).alias("words")), most, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("k"))
    s, t = written(count(docs), "buckets"), written(count(target), "buckets")
    all_s, all_t = (df.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0] for df in (s, t))
    k, m = F.col("k").cast("double"), F.coalesce("m", F.lit(0)).cast("double")
    ratio = (m + 1) * F.lit(float(all_s + buckets)) / ((k + 1) * F.lit(float(all_t + buckets)))
    return s.join(F.broadcast(t.withColumnRenamed("k", "m")), "bucket", "left").select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandth-step Gumbel draw from the first 32 bits of sha256(`seed:doc_id`); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null unless the document is drawn.

    docs: doc_id, text; target: text; other columns are ignored, whatever their names. weight is the floored mean gain
    of the document's n-grams (0 without any), score adds the noise. floor(percent N / 100) of the N documents with at
    least `least_words` words are drawn, by score, then the smaller doc_id (null last). Rows with one doc_id are each
    their own, with one noise. An empty target makes every t 0; an empty table gives an empty result.
    """
    table = gains(docs, target, most, buckets)
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words_of(F.col("text")).alias("words"))
    each = bucketed(each.select("row", "doc_id", F.size("words").alias("n_words"), "words"), most, buckets)
    met = each.join(F.broadcast(table), "bucket", "left")  # `buckets` rows at most
    sums = met.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("s"))
    weight = F.expr("(s - pmod(s, greatest(n_features, 1))) div greatest(n_features, 1)").cast("long")
    scored = sums.select("row", "doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    may = F.col("n_words") >= least_words
    placed = in_order(scored.withColumn("may", may), [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "scores")
    drawn = placed.where("may").count() * percent // 100
    ranked = with_ranks(placed)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
