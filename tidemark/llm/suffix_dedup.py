"""Removal of strings that repeat, from merged shard suffix orders (sparse Burrows-Wheeler transforms).

A full suffix array of the corpus is several times its size, so the transform is sampled. A string's anchor is the
least of its hashed grams (of a third of `span` or less, a power of two), so it depends on the string alone, and
strings that start one after the other mostly have the same. The gram is the first symbol of the anchor's suffix;
suffixes whose first symbol occurs once have no long common prefix with any other and are set aside by a join, and
equal suffixes are counted before any shuffle of their bytes.

Each shard (about a megabyte of documents) sorts its own suffixes and hands them on in that order, each with the
bytes that precede it (the transform's column). Shards are merged by iterative interleave refinement: the interleave
begins with whole shards one after the other, in one block per first symbol; each round deals the rows of blocks
that are still tied by their next eight bytes, keeping the order so far, so rows of one shard never pass each other
and no suffix is sorted again. The round that parts two neighbours yields their common prefix. From the merged order
the same rounds over the preceding bytes give common extensions to the left. A string at distance l before its
anchor repeats if another row shares both its block at left depth and its block at right depth: the repeated
intervals.

Strings are of bytes or of words; of words, each is four bytes of its hash, and what repeats are runs of words,
whatever the case, white space and punctuation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hot_join, mix, row_key, runs, slices, tasks, text_bytes, word_bounds, word_hashes, written

UNITS = {"byte": 1, "word": 4}  # bytes that stand for one


class Shape:
    """Lengths that follow from the span: grams of `gram` bytes, `window` of them in a string."""

    def __init__(self, span: int):
        if span < 24:
            raise ValueError("span must be at least 24 bytes")
        self.span = span
        self.gram = 1 << (span // 3).bit_length() - 1  # all strings of an anchor share it
        self.window = span - self.gram + 1
        self.far = self.window - 1  # most bytes from a string's start to its anchor


def symbols(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """What strings are made of, as bytes, and the rows' offsets."""
    if unit == "byte":
        return text_bytes(column)
    words, off, _ = word_hashes(column)
    return (words >> np.uint64(32)).astype("<u4").view(np.uint8), off * 4


def anchors_of(data: np.ndarray, off: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first string start, last string start) in the joined bytes, for anchors that own a string."""
    none = np.zeros(0, np.int64)
    k, w, n = shape.gram, shape.window, len(data)
    if n < shape.span:
        return none, none, none, none
    h = mix(data.astype(np.uint64) + np.uint64(0x51ED2701))
    size = 1
    while size < k:
        h = h[: len(h) - size] * np.uint64(0x9FB21C651E98DF25) + (h[size:] ^ np.uint64(size))
        h ^= h >> np.uint64(31)
        size *= 2
    # the least hash and, of equal ones, the rightmost: in the low half a larger place is a smaller number
    h = (mix(h) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    if size < w:
        h = np.minimum(h[: len(h) - (w - size)], h[w - size :])
    starts = np.maximum(np.diff(off) - shape.span + 1, 0)
    mark = np.zeros(n + 1, np.int32)
    rows = np.flatnonzero(starts)
    np.add.at(mark, off[rows], 1)
    np.add.at(mark, off[rows] + starts[rows], -1)
    s = np.flatnonzero(np.cumsum(mark)[: len(h)])
    at = np.int64(0xFFFFFFFF) - (h[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else none
    x = at[first]
    return np.searchsorted(off, x, side="right") - 1, x, s[first], s[np.append(first[1:], len(s)) - 1] if len(s) else none


def _anchor_rows(span: int, unit: str):
    def run(batches):
        shape = Shape(span)
        for batch in slices(batches, "text"):
            data, off = symbols(batch.column(1), unit)
            row, x, lo, hi = anchors_of(data, off, shape)
            raw = memoryview(np.ascontiguousarray(data))
            a, b = x.tolist(), (x + shape.gram).tolist()
            key = [xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(a, b)]
            dlo, dhi = x - lo, x - hi
            ctx = [xxhash.xxh3_64_intdigest(raw[i:j], s) for i, j, s in zip(lo.tolist(), (hi + span).tolist(), ((dlo << 20) | dhi).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(np.array(key, np.uint64).view(np.int64)),
                    pa.array(np.array(ctx, np.uint64).view(np.int64)),
                    pa.array(x - off[row]), pa.array(dlo.astype(np.int32)), pa.array(dhi.astype(np.int32)),
                ],
                ["row", "key", "ctx", "x", "dlo", "dhi"],
            )

    return run


def _tail_rows(span: int, unit: str):
    """A shard's suffixes in their order: what follows the shared symbol, and what precedes it, last byte first."""

    def run(batches):
        from pyspark import TaskContext

        shape, shard = Shape(span), TaskContext.get().partitionId() << 24
        for batch in slices(batches, "text"):
            data, off = symbols(batch.column(1), unit)
            out: list[tuple] = []
            for i, (row, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = data[off[i] : off[i + 1]]
                for s in found:
                    x = s["x"]
                    left = text[x - s["dlo"] : x][::-1].tobytes()
                    right = text[x + shape.gram : x - s["dhi"] + span].tobytes()
                    out.append((s["key"], row, s["n"], s["m"], x, s["dlo"], s["dhi"], left, right))
            if out:
                out.sort(key=lambda t: (t[0], t[8]))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), _TAIL_TYPES)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(out), shard)), pa.array(np.arange(len(out), dtype=np.int32))], _TAIL_NAMES)
                shard += 1

    return run


_TAIL_NAMES = ["key", "row", "n", "m", "x", "dlo", "dhi", "left", "right", "shard", "rank"]
_TAIL_TYPES = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] * 2
_TAILS = "key long, row long, n long, m long, x long, dlo int, dhi int, left binary, right binary, shard long, rank int"


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, padded with zeros to whole words of eight, and their lengths."""
    data, off = text_bytes(column)
    length = np.diff(off)
    words = max(1, -(-width // 8))
    out = np.zeros((len(length), words * 8), np.uint8)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(data)) - np.repeat(off[:-1], length)] = data
    return out, length


def interleave(group: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of the rows and the common prefix of each with the one before it, -1 where groups part.

    Rows come shard after shard, each shard's in its own order. All begin in their group's block. Each round deals the
    rows of blocks that are still tied by their next eight bytes, keeping the order so far, and leaves settled blocks
    alone. Where a row is a prefix of another, the shorter one comes first.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    open_ = rows.shape[1] + 1  # not parted yet
    lcp = np.full(n, open_, np.int64)
    lcp[0] = -1
    lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
    words = rows.view(">u8")
    for depth in range(words.shape[1] + 1):
        tied = lcp == open_
        live = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(live):
            break
        block = np.cumsum(~tied)[live]
        held = order[live]
        symbol = (words[held, depth] if depth < words.shape[1] else length[held]).astype(np.uint64)
        parted = symbol[1:] < symbol[:-1]
        parted &= block[1:] == block[:-1]
        if parted.any():  # shards that are not yet interleaved here
            dealt = np.lexsort((symbol, block))
            held, symbol = held[dealt], symbol[dealt]
            order[live] = held
        if depth < words.shape[1]:
            parts = np.flatnonzero((symbol[1:] != symbol[:-1]) & (block[1:] == block[:-1]))
            a, b = rows[held[parts], 8 * depth : 8 * depth + 8], rows[held[parts + 1], 8 * depth : 8 * depth + 8]
            lcp[live[parts + 1]] = 8 * depth + np.argmax(a != b, axis=1)
    both = np.minimum(length[order[1:]], length[order[:-1]])
    lcp[1:] = np.where(lcp[1:] < 0, -1, np.minimum(lcp[1:], both))
    return order, lcp


def repeated(group: np.ndarray, dlo: np.ndarray, dhi: np.ndarray, left: tuple, right: tuple, shape: Shape) -> np.ndarray:
    """rows x distances: whether the string that starts i bytes before the row's anchor is in another row too."""
    n = len(group)
    flag = np.zeros((n, shape.window), bool)
    ranks, lcps, best = [], [], []
    merged = np.arange(n)
    for rows, length in (right, left):  # the left side starts from the merged order of the right
        order, lcp = interleave(group[merged], rows[merged], length[merged])
        merged = merged[order]
        rank = np.empty(n, np.int64)
        rank[merged] = np.arange(n)
        ranks.insert(0, rank)
        lcps.insert(0, lcp)
        best.insert(0, np.maximum(lcp, np.append(lcp[1:], -1))[rank])
    for i in range(shape.window):
        r = shape.far - i
        on = np.flatnonzero((dhi <= i) & (i <= dlo) & (best[0] >= i) & (best[1] >= r))
        if not len(on):
            continue
        pair = np.cumsum(lcps[0] < i)[ranks[0][on]] * np.int64(n + 1) + np.cumsum(lcps[1] < r)[ranks[1][on]]
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        flag[on, i] = count[which] > 1
    return flag


def _span_batch(row: np.ndarray, x: np.ndarray, flag: np.ndarray, shape: Shape) -> pa.RecordBatch:
    """Runs of flagged distances as [start, end) byte spans."""
    edge = np.diff(np.pad(flag, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return pa.RecordBatch.from_arrays([pa.array(row[r]), pa.array(x[r] - past + 1), pa.array(x[r] - first + shape.span)], ["row", "s", "e"])


def _merge_rows(span: int):
    def run(batches):
        shape = Shape(span)
        for t in runs(batches, ["key"], 20_000):
            key, row, n, x, dlo, dhi = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "row", "n", "x", "dlo", "dhi"))
            left, right = (matrix(t.column(c).combine_chunks(), shape.far) for c in ("left", "right"))
            flag = repeated(np.unique(key, return_inverse=True)[1], dlo, dhi, left, right, shape)
            flag[n > 1] = False  # known without the merge
            yield _span_batch(row, x, flag, shape)

    return run


def _string_rows(span: int):
    """For keys with very many rows: each string's digest, to be counted by a shuffle instead of in one task."""

    def run(batches):
        shape = Shape(span)
        for batch in batches:
            out: list[tuple] = []
            for s in batch.to_pylist():
                for l in range(s["dhi"], s["dlo"] + 1):  # noqa: E741
                    d = xxhash.xxh3_128_digest(s["left"][:l] + b"|" + s["right"][: shape.far - l], l)
                    out.append((s["key"], d, s["row"], s["n"], s["x"] - l))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["key", "d", "row", "n", "s"])

    return run


def repeated_spans(docs: DataFrame, dealt: DataFrame, span: int = 400, most: int = 20_000, unit: str = "byte") -> DataFrame:
    """(row, s, e) spans of repeated strings, in bytes of symbols; docs: text, row; dealt: doc, text, row, dealt out by row.

    `most`: rows of one first symbol that a merge task takes; beyond it strings are counted by their 128-bit digests
    in a shuffle, with the same result.
    """
    span = span * UNITS[unit]
    anchors = written(docs.select("row", "text").mapInArrow(_anchor_rows(span, unit), "row long, key long, ctx long, x long, dlo int, dhi int"), "anchors")
    again = written(anchors.groupBy("key").agg(F.count("*").alias("all")).where("all > 1"), "again")
    held = written(hot_join(anchors, again, ["key"], "all"), "held")
    contexts = held.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("row", "x", "dlo", "dhi")).alias("at"))
    contexts = written(contexts, "contexts")
    keys = contexts.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("key", "m")
    keys = written(keys, "open-keys")
    whole = hot_join(held, contexts.where("n > 1").select("key", "ctx", "n"), ["key", "ctx"], "n").select("row", (F.col("x") - F.col("dlo")).alias("s"), (F.col("x") - F.col("dhi") + span).alias("e"))
    open_ = hot_join(contexts, keys, ["key"], "m", "inner").select("at.row", F.struct("key", "n", "m", "at.x", "at.dlo", "at.dhi").alias("s"))
    by_doc = open_.groupBy("row").agg(F.collect_list("s").alias("found"))
    # rows that are equal in id and text share `row` and come as often; their contexts have n > 1, so it changes nothing
    # doc comes along unused: without it Spark would deal out the texts once more, as a narrower table
    tails = dealt.join(by_doc.hint("shuffle_hash"), "row").select("row", "text", "found", "doc").mapInArrow(_tail_rows(span, unit), _TAILS)
    order = ["key", "shard", "rank"]
    spans = whole.unionByName(tails.where(F.col("m") <= most).repartition(tasks(docs), "key").sortWithinPartitions(*order).mapInArrow(_merge_rows(span), "row long, s long, e long"))
    if keys.where(F.col("m") > most).isEmpty():
        return spans
    strings = written(tails.where(F.col("m") > most).mapInArrow(_string_rows(span), "key long, d binary, row long, n long, s long"), "strings")
    counted = strings.groupBy("key", "d").agg(F.sum("n").alias("c"), F.count("*").alias("k")).where("c > 1 AND k > 1").select("key", "d", "k")
    counted = written(counted, "string-counts")
    return spans.unionByName(hot_join(strings.where("n = 1"), counted, ["key", "d"], "k").select("row", "s", (F.col("s") + span).alias("e")))


def _words_in(found: list[dict] | None) -> int:
    """How many words lie in spans of symbols."""
    count = end = 0
    for a, b in sorted((-(-s["s"] // 4), s["e"] // 4) for s in found or ()):
        count += max(0, b - max(a, end))
        end = max(end, b)
    return count


def _cut_rows(unit: str, with_text: bool):
    """Rows of (anything, text, found, further spans of words): what is left of each text."""

    def run(batches):
        for batch in slices(batches, "text"):
            data, off = text_bytes(batch.column(1))
            spots = _word_starts(data, off) if unit == "word" else None
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, found in enumerate(batch.column(2).to_pylist()):
                text = data[off[i] : off[i + 1]]
                count = 0
                if found:
                    found.sort(key=lambda s: s["s"])
                    keep = np.ones(len(text), bool)
                    end = -1
                    for s in found:
                        a, b = s["s"], s["e"]
                        if spots:
                            a, b = spots[i][-(-a // 4)], spots[i][b // 4]
                        keep[a:b] = False
                        count += a > end
                        end = max(end, b)
                    removed = int(len(text) - keep.sum())
                    kept = text[keep].tobytes()
                else:
                    removed, kept = 0, text.tobytes()
                out["n_bytes"].append(len(text))
                out["n_removed"].append(removed)
                out["n_spans"].append(count)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept"].append(kept.decode("utf-8", "ignore"))
            arrays = [batch.column(0)] + [pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")] + [pa.array(out["kept_sha256"], pa.string())]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(out["kept"], pa.string()))
                names.append("kept_text")
            if batch.num_columns > 3:
                arrays.append(pa.array([_words_in(found) for found in batch.column(3).to_pylist()], pa.int64()))
                names.append("n_repeated_words")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _word_starts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Where each row's words start, and its end; a removed word takes what follows it up to the next one along."""
    start = word_bounds(data, off)[0]
    at = np.searchsorted(start, off)
    return [np.append(start[a:b] - o, e - o) for a, b, o, e in zip(at[:-1], at[1:], off[:-1], off[1:])]


def _cut(docs: DataFrame, doc: Column, span: int, unit: str, most: int, with_text: bool, words: int | None = None) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, kept_text, n_repeated_words) of each row."""
    base = docs.select(doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"), row_key("doc_id", F.coalesce("text", F.lit(""))).alias("row"))
    dealt = base.repartition(tasks(docs), "row")  # one exchange of the texts serves all joins
    spans = repeated_spans(base.select("row", "text"), dealt, span, most, unit).select("row", F.struct("s", "e").alias("cut"))
    lists = [F.collect_list("cut").alias("found")]
    if words:
        again = repeated_spans(base.select("row", "text"), dealt, words, most, "word").select("row", F.struct("s", "e").alias("run"))
        spans = spans.unionByName(again, allowMissingColumns=True)
        lists.append(F.collect_list("run").alias("again"))
    spans = spans.groupBy("row").agg(*lists)
    schema = [base.schema["doc"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), *(T.StructField(n, T.StringType()) for n in ["kept_sha256", "kept_text"][: 1 + with_text])]
    schema += [T.StructField("n_repeated_words", T.LongType())] * bool(words)
    return dealt.join(spans.hint("shuffle_hash"), "row", "left").select("doc", "text", *spans.columns[1:]).mapInArrow(_cut_rows(unit, with_text), T.StructType(schema))


def remove_repeats(docs: DataFrame, span: int = 400, with_text: bool = False, most: int = 20_000, unit: str = "byte", words: int | None = None) -> DataFrame:
    """One row per document with what is left once every byte of a repeated string of `span` units is gone.

    docs: doc_id, text; other columns are ignored, whatever their names. `unit` is byte or word (see the top; a word
    goes with what stands between it and the next). A null or short text keeps all its bytes (null: none). Matches never
    cross documents; overlapping matches within one document count. Rows that repeat both id and text are two
    occurrences and lose the same bytes; rows with one id and other texts are handled apart. An empty table gives an
    empty result. `with_text` adds the kept text; a character cut in two is dropped there, while kept_sha256 is over
    the exact bytes. `words` adds n_repeated_words, how many of the document's words lie in runs of that many words which
    also start anywhere else, whatever `span` removes: passages of so many words are often shorter than a span of bytes.
    """
    return _cut(docs, F.col("doc_id"), span, unit, most, with_text, words).withColumnRenamed("doc", "doc_id")


def without_repeats(docs: DataFrame, span: int = 50, unit: str = "word", length: str | None = None, most: int = 20_000) -> DataFrame:
    """docs (all columns, all rows) with what remove_repeats leaves of each text; nulls stay null.

    `length`: a column that counts the text's characters, if there is one; it is set anew where a text was cut.
    """
    others = [c for c in docs.columns if c != "text"]
    out = _cut(docs, F.struct(*[docs[c] for c in others], docs["text"].isNull().alias(ABSENT)), span, unit, most, True)
    text = F.when(~F.col("doc")[ABSENT], F.col("kept_text"))
    shown = {c: F.col("doc")[c] for c in others} | {"text": text}
    if length in others:
        shown[length] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(shown[length])
    return out.select(*[shown[c].alias(c) for c in docs.columns])


ABSENT = "text is null"  # no docs column
