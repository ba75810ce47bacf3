"""Helpers the training-data operators share: the shared folder, Arrow slices, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return root.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 500 rows and 8 MB at most, where the session still has the default of 10000 rows.

    Texts are long: two tasks' batches of 10000 of them would take a good part of an executor's memory.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, "500")
        spark.conf.set(size, "8m")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, so that a lost executor costs one read."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """Shuffle partitions for explicit deals; follows the session, which follows the input."""
    small_batches(df.sparkSession)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols) -> F.Column:
    """64 bits that stand for a row's id and text, so that rows with one id but other texts stay apart."""
    return F.xxhash64(*cols)


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "left_semi", least: int = 10_000) -> DataFrame:
    """left joined with right (a row per key; `weight`: how many rows of left have it), however the keys are spread.

    Keys with over a thousandth of all rows (and over `least` rows) are fewer than a thousand, so they are broadcast
    and their rows stay where they are; no task of the shuffle join gets more than that of one key.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    most = max(least, total // 1000)
    hot = right.where(F.col(weight) > most)
    if hot.isEmpty():
        return left.join(right, on, how)
    mark = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on, "inner" if how == "left" else how).unionByName(mark.join(right.where(F.col(weight) <= most), on, how))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about `most` bytes of `column`, at least one row each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = text_bytes(batch.column(batch.schema.names.index(column)))
        at = 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end and the n + 1 offsets; a null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of each word of the rows; lower-casing a text changes neither their number nor their order."""
    n = len(data)
    is_word = _WORD[data]
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    cuts = off[1:-1]
    first = np.zeros(n, bool)
    first[cuts[cuts < n]] = True
    start = np.flatnonzero(is_word & (~before | first))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:] & ~first[1:]
    return start, np.flatnonzero(is_word & ~after) + 1


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all rows: 64-bit hash of each, the row offsets into them, and each word's byte start.

    A word is a maximal run of ASCII letters, digits, underscores and non-ASCII bytes.
    """
    lowered = pa.array([x.lower() if x else "" for x in column.to_pylist()], pa.large_string())
    data, off = text_bytes(lowered)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
    start, end = word_bounds(data, off)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _powers(_INVERSE, n)[start]
    return mix(h), np.searchsorted(start, off), start


def shingles(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles and their row offsets; a row of 1 to n - 1 words has one of them all."""
    count = np.diff(off)
    out = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(out)))
    at = np.repeat(off[:-1] - to[:-1], out) + np.arange(to[-1])
    last = np.repeat(off[1:], out)
    h = np.zeros(to[-1], np.uint64)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    for i in range(n):
        w = padded[at + i]
        if i:
            w = np.where(at + i < last, w, np.uint64(0))
        h = (h ^ w) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i + 1)
        h ^= h >> np.uint64(32)
    return mix(h), to


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


class Members:
    """Places of 64-bit hashes in a sorted set, most non-members being refused by a small table."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if absent."""
        out = np.full(len(h), -1, np.int64)
        if len(self.values):
            may = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.values, h[may]), len(self.values) - 1)
            hit = self.values[at] == h[may]
            out[may[hit]] = at[hit]
        return out


def runs(batches: Iterator[pa.RecordBatch], key: list[str], least: int) -> Iterator[pa.Table]:
    """Rows that come sorted by `key`, in tables of at least `least` rows that split no key's rows."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held).combine_chunks()
        keys = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in key]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held, rows = [table.slice(cut)], table.num_rows - cut
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): each node's least reachable node, for undirected edges (src, dst).

    Each round a node follows the one that a hash puts first among itself and its neighbours, and edges are rewritten
    between those followed, which about halves them; every round is written, so that plans stay short. The rounds'
    maps are then composed from the last one back. Nulls and loops are left out; without edges the result is empty.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    e = written(e.distinct(), "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        if len(maps) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = e.union(e.select("dst", "src"))
        first = lambda c, r=len(maps): F.struct(F.xxhash64(c, F.lit(r)), F.col(c).alias("n"))
        near = both.groupBy("src").agg(F.min(first("dst")).alias("k"))
        to = written(near.select(F.col("src").alias("node"), F.least("k", first("src"))["n"].alias("to")), "follow")
        maps.append(to)
        a, b = to.select(F.col("node").alias("src"), F.col("to").alias("a")), to.select(F.col("node").alias("dst"), F.col("to").alias("b"))
        e = e.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        e = written(e.distinct(), "edges")
    if not maps:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    whole = maps[-1]
    for to in reversed(maps[:-1]):
        up = whole.select(F.col("node").alias("to"), F.col("to").alias("up"))
        whole = written(to.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to")), "follow")
    # a root is in its own component, though it may not have followed itself in every round
    least = written(whole.groupBy("to").agg(F.min("node").alias("component")), "components")
    return written(whole.join(least, "to").select("node", "component"), "components")
