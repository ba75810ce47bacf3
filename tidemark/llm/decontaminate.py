"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment of the passages they point at.

A seed is a pair of words at most two apart. An alignment that reaches the threshold has so few changes that some of
its neighbouring matches must be at most two apart in both texts, and how many is known from the item's length; so
an item's most common pairs can be passed over, word frequencies over the whole corpus telling which, as long as enough
rare ones are left. Documents meet the seeds in a Spark join on their hashes. Where enough seeds of an item stand near
each other is a passage, which is joined with the item's words and aligned with them word by word. No document whose
alignment reaches the threshold is lost.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Members, hot_join, row_key, signed, slices, tasks, word_hashes, written

MATCH, MISMATCH, GAP = 2, -1, -1
NUMBER = np.int64(2**63 - 1)  # of a word's hash in alignments, where numbers below 0 match nothing


def _count_rows(words: np.ndarray | None):
    """(word, n) of each slice; n of no word: all words."""

    def run(batches):
        known = Members(words) if words is not None else None
        for batch in slices(batches, "text"):
            h, _, _ = word_hashes(batch.column(0))
            hit = h[known.find(h) >= 0] if known else h
            word, n = np.unique(hit, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*signed(word).tolist(), None], pa.int64()), pa.array([*n.tolist(), len(h)], pa.int64())], ["word", "n"])

    return run


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of word hashes."""
    h = (first * np.uint64(0xD6E8FEB86659FD93)) ^ second
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def singles(words: np.ndarray) -> np.ndarray:
    """Hashes of words alone, as seeds of items too short for pairs."""
    return pairs(words, np.full(len(words), 1, np.uint64))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score, and the passage's first and past-the-last word.

    One row of the table at a time for all pairs; gaps along the passage are a running maximum.
    """
    rows, cols = max(map(len, items)), max(map(len, passages))
    a, b = np.full((len(items), rows), -2, np.int64), np.full((len(items), cols), -1, np.int64)
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    h, start = np.zeros((len(items), cols + 1), np.int32), np.tile(np.arange(cols + 1, dtype=np.int32), (len(items), 1))
    best, first, last = (np.zeros(len(items), np.int32) for _ in range(3))
    slope = -GAP * np.arange(cols + 1, dtype=np.int32)
    each = np.arange(len(items))
    big = np.int64(1 << 32)
    for r in range(rows):
        diag = h[:, :-1] + np.where((b == a[:, r, None]) & (b >= 0), MATCH, MISMATCH).astype(np.int32)
        up = h[:, 1:] + GAP
        new, at = np.zeros_like(h), np.tile(np.arange(cols + 1, dtype=np.int32), (len(items), 1))
        took = np.maximum(diag, up)
        pos = took > 0
        new[:, 1:] = np.where(pos, took, 0)
        at[:, 1:] = np.where(pos, np.where(diag >= up, start[:, :-1], start[:, 1:]), at[:, 1:])
        packed = (new + slope).astype(np.int64) * big + (cols - at)
        run = np.maximum.accumulate(packed, axis=1)
        value = (run >> 32).astype(np.int32) - slope
        start = np.where(value > 0, cols - (run & (big - 1)), np.arange(cols + 1)).astype(np.int32)
        h = np.maximum(value, 0)
        col = h.argmax(1)
        top = h[each, col]
        up_to = top > best
        best, first, last = np.where(up_to, top, best), np.where(up_to, start[each, col], first), np.where(up_to, col, last)
    return best, first, last


def bounds(length: int, least: float) -> tuple[int, int]:
    """(pairs, span) for an alignment of score `least` with an item of `length` words.

    m matches and x changes score 2m - x >= t. A step between neighbouring matches that is over two words long in either
    text takes two changes, so at least (m - 1) - x // 2 >= t / 2 - 1 steps are not; and the passage has m + x words at most.
    """
    t = max(1, ceil(MATCH * length * least - 1e-9))
    return (t + 1) // 2 - 1, max(1, 3 * length - t)


def seeds_of(words: np.ndarray, share: np.ndarray, least: float, rare: float) -> tuple[np.ndarray, int, int]:
    """An item's seeds, how many of them a passage must have, and within how many words.

    Up to half of the steps that are certain may be given away: the likeliest pairs over `rare` aren't seeds. An item
    for which no step is certain has its words as seeds.
    """
    n, span = bounds(len(words), least)
    if n < 1:
        return np.unique(singles(words)), 1, span
    h = np.concatenate([pairs(words[:-d], words[d:]) for d in (1, 2)])
    odds = np.concatenate([share[:-d] * share[d:] for d in (1, 2)])
    gram, at, times = np.unique(h, return_index=True, return_counts=True)
    odds, spare, kept = odds[at], n // 2, np.ones(len(gram), bool)
    for i in np.argsort(-odds, kind="stable"):
        if odds[i] <= rare or times[i] > spare:
            break
        kept[i], spare = False, spare - times[i]
    return gram[kept], n - (n // 2 - spare), span


def _item_rows(longest: int):
    """Word hashes of items, and of each of their stretches if they are long; the last stretch ends with the item."""

    def run(batches):
        for batch in slices(batches, "text"):
            words, off, _ = word_hashes(batch.column(1))
            words, at, part, out = signed(words), batch.column(0).to_pylist(), [], []
            for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
                for s in range(a, b, longest):
                    part.append(at[i])
                    out.append(words[max(a, min(s, b - longest)) : min(b, s + longest)])
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["at", "words"])

    return run


def _seed_rows(rare: float, least: float, total: float):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for item, words in zip(*(c.to_pylist() for c in batch.columns)):
                words.sort(key=lambda w: w["pos"])
                own, share = np.array([w["word"] for w in words], np.int64).view(np.uint64), (np.array([w["n"] for w in words]) + 1) / max(1.0, total)
                gram, need, span = seeds_of(own, share, least, rare)
                out += [(g, item, need, span, len(own)) for g in signed(gram).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["gram", "part", "need", "span", "length"])

    return run


def dense(part: np.ndarray, doc: np.ndarray, pos: np.ndarray, need: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i and ends of windows of `need` hits within `span` words, of hits sorted by (part, doc, pos)."""
    end = np.arange(len(pos)) + need - 1
    ok = end < len(pos)
    end = np.minimum(end, len(pos) - 1)
    ok &= (part[end] == part) & (doc[end] == doc) & (pos[end] - pos <= span)
    return np.flatnonzero(ok), end[ok]


class Sift:
    """Seeds as arrays: which hits of a text stand densely enough for some item."""

    def __init__(self, seeds: pa.Table):
        gram, part, need, span = (seeds.column(c).to_numpy() for c in ("gram", "part", "need", "span"))
        order = np.argsort(gram.view(np.uint64), kind="stable")
        ids, self.part = np.unique(part[order], return_inverse=True)
        self.need, self.span = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        self.need[self.part], self.span[self.part] = need[order], span[order]
        self.known = Members(gram.view(np.uint64))
        self.first = np.searchsorted(gram.view(np.uint64)[order], np.append(self.known.values, np.uint64(2**64 - 1)))
        self.first[-1] = len(gram)

    def hits(self, gram: np.ndarray, spot: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places of the hits to keep among candidate grams at words `spot`."""
        at = self.known.find(gram)
        hit = np.flatnonzero(at >= 0)
        if not len(hit):
            return hit
        a, n = self.first[at[hit]], self.first[at[hit] + 1] - self.first[at[hit]]
        which = np.repeat(hit, n)
        part = self.part[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        pos = spot[which]
        order = np.lexsort((pos, part))
        part, pos, which = part[order], pos[order], which[order]
        new = np.append(True, (part[1:] != part[:-1]) | (pos[1:] != pos[:-1]))  # a word counts once for a part
        u = np.flatnonzero(new)
        doc = np.searchsorted(off, pos[u], side="right")
        i, end = dense(part[u], doc, pos[u], self.need[part[u]], self.span[part[u]])
        mark = np.zeros(len(u) + 1, np.int64)
        np.add.at(mark, i, 1)
        np.add.at(mark, end + 1, -1)
        return np.unique(which[u[np.cumsum(mark[:-1]) > 0]])


def _hit_rows(sift, short: bool):
    """Documents with their words and where seeds start in them: those that stand densely enough, or all grams without a sift."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            words, off, _ = word_hashes(batch.column(1))
            spot, gram = [], []
            for d in (0, 1, 2) if short else (1, 2):
                at = np.arange(max(0, len(words) - d))
                at = at[at + d < off[np.searchsorted(off, at, side="right")]]
                spot.append(at)
                gram.append(pairs(words[at], words[at + d]) if d else singles(words[at]))
            spot, gram = np.concatenate(spot), np.concatenate(gram)
            if sift is not None:
                kept = sift.value.hits(gram, spot, off)
                spot, gram = spot[kept], gram[kept]
            doc = np.searchsorted(off, spot, side="right") - 1
            order = np.argsort(doc, kind="stable")
            spot, gram, doc = spot[order], signed(gram)[order], doc[order]
            held, first = np.unique(doc, return_index=True)
            if not len(held):
                continue
            cuts = pa.array(np.append(first, len(doc)), pa.int32())
            hits = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(gram), pa.array((spot - off[doc]).astype(np.int32))], ["gram", "pos"]))
            texts = pa.array([signed(words[off[d] : off[d + 1]]) for d in held], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(held))), batch.column(0).take(pa.array(held)), texts, hits], ["row", "doc_id", "words", "hits"])
            row += len(held)

    return run


def _window_rows(batches):
    """Stretches of a document that an item's seeds point at: (row, part, a, b, k).

    Every alignment of a window's seeds lies within the span around them. Stretches that overlap are joined, and cut
    with an overlap of more than a span where they are over four spans long, so that an alignment is whole in one.
    """
    for batch in batches:
        out: list[tuple] = []
        for row, part, need, span, pos in zip(*(c.to_pylist() for c in batch.columns)):
            pos = np.unique(np.array(pos, np.int64))
            same = np.zeros(len(pos), np.int64)
            i, end = dense(same, same, pos, same + need, same + span)
            a, b = np.maximum(0, pos[end] - span - 3), pos[i] + span + 3
            if not len(a):
                continue
            heads = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
            for x, y in zip(a[heads].tolist(), b[np.append(heads[1:] - 1, len(b) - 1)].tolist()):
                while True:
                    to = min(y, x + 4 * span + 16)
                    out.append((row, part, x, to, int(np.count_nonzero((pos >= x) & (pos < to)))))
                    if to == y:
                        break
                    x = to - span - 8
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "part", "a", "b", "k"])


def _score_rows(cells: int = 1 << 20):
    """Alignments of passages with their items, many at a time while their table's row stays under `cells`."""

    def run(batches):
        for batch in batches:
            row, part, a, k = (batch.column(i).to_numpy() for i in range(4))
            passage, item = ([v.values.to_numpy() & NUMBER for v in batch.column(i)] for i in (4, 5))
            size, wide = np.array([len(v) for v in item]), np.array([len(v) for v in passage])
            todo, out = np.lexsort((wide, size)).tolist(), []
            while todo:
                n = 1
                while n < min(256, len(todo)) and (n + 1) * max(wide[i] for i in todo[: n + 1]) <= cells:
                    n += 1
                now, todo = todo[:n], todo[n:]
                score, first, past = align([item[i] for i in now], [passage[i] for i in now])
                out += [(int(row[i]), int(part[i]), float(x) / (MATCH * int(size[i])), int(a[i] + s), int(a[i] + e), int(k[i])) for i, x, s, e in zip(now, score, first, past)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["row", "part", "score", "first_word", "past_word", "n_seeds"])

    return run


def _few(df: DataFrame, most: int) -> pa.Table | None:
    """The rows as an Arrow table if there are at most `most`."""
    return df.toArrow() if df.count() <= most else None


def contaminated(docs: DataFrame, benchmark: DataFrame, rare: float = 1e-7, least: float = 0.5, longest: int = 512, most_sift: int = 2_000_000) -> DataFrame:
    """Rows (doc_id, item_id, score, first_word, past_word, n_seeds): documents with a passage like a test item.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored, whatever their names. score is the best
    local alignment of lower-cased words over that of an exact copy (1.0); rows have score >= `least`, and every
    document and item with such an alignment has a row. Seeds are pairs of words at most two apart, without the likeliest
    of those whose words' corpus frequencies multiply to over `rare`. n_seeds counts those in the passage.
    An item of over `longest` words is matched in stretches of that many, of which the best counts. Null or wordless
    texts match nothing; rows that repeat give rows that repeat, items with equal ids or texts are kept apart. Empty tables give
    an empty result.

    Seeds sift the documents in the scan, as arrays of 32 bytes a seed, if there are at most `most_sift` of them (64 MB);
    beyond it all pairs of words go to the join, with the same result.
    """
    id_type, spark = dict(docs.dtypes)["doc_id"], docs.sparkSession
    items = written(benchmark.select("item_id", "text").where("text IS NOT NULL").withColumn("at", F.monotonically_increasing_id()), "items")
    parts = items.select("at", "text").mapInArrow(_item_rows(longest), "at long, words array<long>").withColumn("part", F.monotonically_increasing_id())
    parts = written(parts, "item-parts")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    placed = parts.select("part", F.posexplode("words").alias("pos", "word"))
    few = _few(placed.select("word").distinct(), most_sift)
    counts = texts.select("text").mapInArrow(_count_rows(None if few is None else few.column("word").to_numpy().view(np.uint64)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    shares = placed.join(counts, "word", "left").groupBy("part").agg(F.collect_list(F.struct("pos", "word", F.coalesce("n", F.lit(0)).alias("n"))).alias("words"))  # `longest` words at most
    seeds = written(shares.mapInArrow(_seed_rows(rare, least, float(total)), "gram long, part long, need long, span long, length long"), "seeds")
    short = not seeds.where(F.col("length") <= 1 / least).isEmpty()
    few = _few(seeds.select("gram", "part", "need", "span"), most_sift)
    sift = spark.sparkContext.broadcast(Sift(few)) if few is not None and few.num_rows else None
    held = texts.mapInArrow(_hit_rows(sift, short), f"row long, doc_id {id_type}, words array<long>, hits array<struct<gram:long,pos:int>>")
    held = written(held if few is None or few.num_rows else held.where("false"), "seeded")
    hits = held.select("row", F.explode("hits").alias("h")).select("row", "h.gram", "h.pos")
    sized = seeds.join(hits.groupBy("gram").agg(F.count("*").alias("m")), "gram")
    met = hot_join(hits, written(sized, "met-seeds"), ["gram"], "m", "inner")
    found = met.groupBy("row", "part", "need", "span").agg(F.collect_set("pos").alias("pos"))  # a document's words at most
    windows = written(found.mapInArrow(_window_rows, "row long, part long, a long, b long, k long"), "windows")
    passages = windows.join(held.select("row", "words"), "row").select("row", "part", "a", "k", F.slice("words", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("passage"))
    passages = written(passages, "passages")
    use = parts.join(passages.groupBy("part").agg(F.count("*").alias("m")), "part").select("part", F.col("words").alias("item"), "m")
    scored = hot_join(passages, use, ["part"], "m", "inner").select("row", "part", "a", "k", "passage", "item")
    scored = scored.repartition(tasks(docs)).mapInArrow(_score_rows(), "row long, part long, score double, first_word long, past_word long, n_seeds long")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), (-F.col("past_word")).alias("end"), "n_seeds")).alias("b")
    top = written(scored, "scored").join(parts.select("part", "at"), "part").groupBy("row", "at").agg(best).where(F.col("b.score") >= least)
    top = top.join(items.select("at", "item_id"), "at").join(held.select("row", "doc_id"), "row")
    return top.select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.back")).alias("first_word"), (-F.col("b.end")).alias("past_word"), F.col("b.n_seeds").alias("n_seeds"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs (all columns) without those that have a passage like a test item, told apart by id and text."""
    keyed = docs.select(row_key("doc_id", "text").alias("row"), F.struct("*").alias("doc"))  # no name in docs can clash
    bad = contaminated(keyed.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), benchmark, **how).select(F.col("doc_id").alias("row")).distinct()
    return keyed.join(bad, "row", "left_anti").select("doc.*")
