"""Streams that remember: quotes captured once, stale ones set apart, and a drift monitor that keeps its sums by key.

State lives in the query's checkpoint, so a query that stops goes on where it was. Every operator has a batch twin, and
gives the same rows as it for all rows that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.scans import scan

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def captured(quotes: DataFrame, key: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key; a stream forgets a key once the watermark, `late` behind, has passed it.

    In a batch the earliest row of each key stays. Quotes that come again after the stream forgot them count anew.
    """
    if quotes.isStreaming:
        return quotes.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))
    row = F.min_by(F.struct("*"), F.struct(time, F.xxhash64(*quotes.columns))).alias("_r")
    return quotes.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(row).select("_r.*")


def staleness(quotes: DataFrame, updated: str, taken: str, most_minutes: float) -> DataFrame:
    """quotes with age_minutes and rejected: null, 'missing_update', 'future_update' or 'stale'. No state: for streams and batches."""
    age = (F.unix_micros(F.col(taken).cast("timestamp")) - F.unix_micros(F.col(updated).cast("timestamp"))) / 60_000_000
    why = F.when(F.col("age_minutes").isNull(), "missing_update").when(F.col("age_minutes") < 0, "future_update").when(F.col("age_minutes") > most_minutes, "stale")
    return quotes.withColumn("age_minutes", age).withColumn("rejected", why)


def _moved(up: float, down: float, r: float, slack: float, limit: float) -> tuple[float, float, bool]:
    up, down = max(0.0, up + r - slack), max(0.0, down - r - slack)
    return up, down, up > limit or down > limit


#: A row that waits, how many of them are sorted at once, and how many make a value of the state.
_ROW = np.dtype([("at", "<i8"), ("id", "<i8"), ("r", "<f8")])
_RUN, _CHUNK = 250_000, 4_096


def _through(rows: np.ndarray, bound: np.void) -> int:
    """How many of the sorted rows are not after `bound`."""
    lo, hi = 0, len(rows)
    for f in _ROW.names:
        part = rows[f][lo:hi]
        lo, hi = lo + int(np.searchsorted(part, bound[f], "left")), lo + int(np.searchsorted(part, bound[f], "right"))
    return hi


def _sorted(rows: list[np.ndarray]) -> np.ndarray:
    all_ = np.concatenate(rows)
    return all_[np.lexsort((all_["r"], all_["id"], all_["at"]))]


class DriftProcessor(StatefulProcessor):
    """Two-sided sums of a key's residuals in event-time order; rows wait in state until the watermark has passed them.

    What waits are sorted runs in chunks of a few thousand rows, merged as the watermark passes: a worker holds a run
    that it sorts or a chunk of every run, however many rows a key has.
    """

    def __init__(self, slack: float, limit: float):
        self.slack, self.limit = slack, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "up double, down double, seen long")
        self.runs = handle.getValueState("runs", "n long")
        self.held = handle.getMapState("chunks", "run long, part long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block, n, first = [], 0, None
        for new in rows:
            block.append(a := np.empty(len(new), _ROW))
            for f in _ROW.names:
                a[f] = new[f]
            n, first = n + len(a), min(int(a["at"].min()), first if first is not None else int(a["at"][0]))
            if n >= _RUN:
                self._hold(block)
                block, n = [], 0
        if block:
            self._hold(block)
        if first is not None:
            self._wake(first)
        yield from ()

    def _hold(self, block: list[np.ndarray]) -> None:
        rows, run = _sorted(block), self.runs.get()[0] if self.runs.exists() else 0
        self.runs.update((run + 1,))
        for part, i in enumerate(range(0, len(rows), _CHUNK)):
            self.held.updateValue((run, part), (rows[i : i + _CHUNK].tobytes(),))

    def _wake(self, at: int) -> None:
        """A timer for the key's earliest row that waits; there is one at most."""
        due, timers = at // 1000 + 1, [int(t) for t in self.handle.listTimers()]
        if not timers or due < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def _passed(self, until: int) -> Iterator[np.ndarray]:
        """The rows before `until` in order, taken out of the state; the rest stays, with a timer for its first."""
        left: dict[int, list[int]] = {}
        for run, part in sorted((int(k[0]), int(k[1])) for k in self.held.keys()):
            left.setdefault(run, []).insert(0, part)
        now: dict[int, np.ndarray] = {}
        at: dict[int, int] = {}

        def load(run: int) -> None:
            at[run] = left[run].pop()
            now[run] = np.frombuffer(bytes(self.held.getValue((run, at[run]))[0]), _ROW)
            self.held.removeKey((run, at[run]))

        more = list(left)
        while more:
            for run in more:
                load(run)
            ends = [now[run][-1] for run in now if left[run]]  # what follows a chunk is not before its last row
            bound = min(ends, key=lambda x: x.item()) if ends else None
            taken = []
            for run, rows in now.items():
                n = min(len(rows) if bound is None else _through(rows, bound), int(np.searchsorted(rows["at"], until, "left")))
                taken.append(rows[:n])
                now[run] = rows[n:]
            if sum(map(len, taken)):
                yield _sorted(taken)
            more = [run for run in now if not len(now[run]) and left[run]]
        small, total = [], 0
        for run in sorted((run for run in now if len(now[run])), key=lambda run: len(now[run])):
            if not left[run] and total + len(now[run]) <= _CHUNK:  # ends of runs go on as one
                small.append(run)
                total += len(now[run])
            else:
                self.held.updateValue((run, at[run]), (now[run].tobytes(),))
        if small:
            self.held.updateValue((small[0], at[small[0]]), (_sorted([now[run] for run in small]).tobytes(),))
        first = [int(rows["at"][0]) for rows in now.values() if len(rows)]
        if first:
            self.handle.registerTimer(min(first) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        up, down, seen = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0)
        for rows in self._passed(timerValues.getCurrentWatermarkInMs() * 1000):
            out = []
            for i, r in zip(rows["id"].tolist(), rows["r"].tolist()):
                up, down, hit = _moved(up, down, r, self.slack, self.limit)
                seen += 1
                out.append((key[0], i, up, down, hit, seen))
                if hit:
                    up = down = 0.0
            yield pd.DataFrame(out, columns=["k", "id", "up", "down", "alarm", "seen"]).astype({"k": object})
        self.sums.update((up, down, seen))

    def close(self) -> None:
        pass


def drift_monitor(rows: DataFrame, key: str, time: str, identifier: str, residual: str | Column, late: str = "10 minutes", slack: float = 0.02, limit: float = 3.0) -> DataFrame:
    """(k, id, up, down, alarm, seen) of each row: its key's sums after it, in order of time and identifier.

    Both begin again after an alarm. A null residual counts as 0; rows without a key, time or identifier are left out. A stream
    gives a row once the watermark, `late` behind, has passed it, so rows that come out of order are put in order; its
    batch twin gives all. Streams need state_store().
    """
    r = F.coalesce(F.nanvl((F.col(residual) if isinstance(residual, str) else residual).cast("double"), F.lit(0.0)), F.lit(0.0))
    t = rows.select(F.col(key).cast("string").alias("k"), F.col(time).cast("timestamp").alias("t"), F.col(identifier).cast("long").alias("id"), r.alias("r")).where("k IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL")
    schema = "k string, id long, up double, down double, alarm boolean, seen long"
    if rows.isStreaming:
        t = t.withWatermark("t", late).withColumn("at", F.unix_micros("t"))
        return t.groupBy("k").transformWithStateInPandas(DriftProcessor(slack, limit), schema, "Append", "EventTime")

    def step(s: list, r: float) -> tuple:
        s[0], s[1], hit = _moved(s[0], s[1], r, slack, limit)
        s[2] += 1
        out = (s[0], s[1], hit, s[2])
        if hit:
            s[0] = s[1] = 0.0
        return out

    from pyspark.sql import types as T

    return scan(t, ["k"], ["t", "id"], ["r"], lambda: [0.0, 0.0, 0], step, {"up": T.DoubleType(), "down": T.DoubleType(), "alarm": T.BooleanType(), "seen": T.LongType()}).select("k", "id", "up", "down", "alarm", "seen")


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which keyed state needs; the session is as before after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def drain_into(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over the files there are now and adds its rows to a Parquet table; a later call with the checkpoint goes on."""
    with state_store(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
