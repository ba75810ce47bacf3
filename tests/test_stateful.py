"""Streams with a restart in the middle against their batch twins."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import stateful

T0 = datetime(2024, 5, 1)
LATE = timedelta(minutes=10)


def parts(seed=9, n=360):
    """Four arrivals of rows in time order but for shifts of up to four minutes; the key k0 has most of them."""
    r = random.Random(seed)
    rows = [(i, "k0" if r.random() < 0.6 else f"k{r.randrange(1, 4)}", T0 + timedelta(minutes=i), r.choice([None, 0.9, -0.9, 0.4, -0.3, 1.2])) for i in range(n)]
    rows = sorted(rows, key=lambda x: x[2] + timedelta(minutes=r.uniform(0, 4)))
    return [rows[k : k + n // 4] for k in range(0, n, n // 4)]


SCHEMA = "id long, k string, t timestamp, r double"


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def folders(spark, tmp_path):
    arrivals = parts()
    write = lambda k: spark.createDataFrame(arrivals[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return arrivals, write, {n: str(tmp_path / n) for n in ("in", "out", "state")}


class Kept:
    """Spark's state and timers for one key, in dicts."""

    def __init__(self):
        self.values, self.timers = {}, set()
        self.largest = 0

    def getValueState(self, name, schema):  # noqa: N802
        box = SimpleNamespace(exists=lambda: name in self.values, get=lambda: self.values[name], update=lambda v: self.values.__setitem__(name, v))
        return box

    def getMapState(self, name, key, schema):  # noqa: N802
        at = self.values.setdefault(name, {})

        def put(k, v):
            self.largest = max(self.largest, len(v[0]))
            at[k] = v

        return SimpleNamespace(keys=lambda: iter(list(at)), getValue=lambda k: at[k], removeKey=lambda k: at.pop(k), updateValue=put)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)


def test_a_hot_key_waits_in_chunks(monkeypatch):
    """Runs and chunks of a few rows give the order of all rows, and no value or output grows with the key."""
    monkeypatch.setattr(stateful, "_RUN", 50)
    monkeypatch.setattr(stateful, "_CHUNK", 8)
    r, kept = random.Random(4), Kept()
    rows = [(r.randrange(400) * 1000, i // 2, r.choice([0.5, -0.5, 1.2])) for i in range(700)]
    p = stateful.DriftProcessor(0.02, 1.5)
    p.init(kept)
    out, sizes, seen = [], [], 0
    for k, mark in ((0, 90), (1, 91), (2, 300), (3, 1000)):
        part = [x for x in rows[k * 175 : k * 175 + 175] if x[0] >= seen]
        frame = pd.DataFrame(part, columns=["at", "id", "r"])
        assert list(p.handleInputRows(("k",), iter([frame[i : i + 20] for i in range(0, len(frame), 20)]), None)) == []
        assert len(kept.timers) == 1
        kept.timers.clear()
        for x in p.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None):
            sizes.append(len(x))
            out += x.values.tolist()
        seen = mark * 1000
    want, up, down, low = [], 0.0, 0.0, 0
    for k, mark in ((0, 90), (1, 91), (2, 300), (3, 1000)):
        want += [(*x, k) for x in rows[k * 175 : k * 175 + 175] if x[0] >= low]
        low = mark * 1000
    for n, (_, i, d, _) in enumerate(sorted(want), 1):
        up, down, hit = stateful._moved(up, down, d, 0.02, 1.5)
        assert out[n - 1] == ["k", i, up, down, hit, n]
        up, down = (0.0, 0.0) if hit else (up, down)
    assert len(out) == len(want) and kept.largest <= 8 * 24 and not kept.values["chunks"] and not kept.timers
    assert max(sizes) < 250


def test_drift_goes_on_after_a_restart(spark, folders):
    arrivals, write, at = folders
    for k in range(4):  # each arrival is a query of its own: it ends, and the next goes on from the checkpoint
        write(k)
        stateful.drain_into(stateful.drift_monitor(stream(spark, at["in"]), "k", "t", "id", "r", "10 minutes", 0.02, 1.5), at["out"], at["state"])
    got = sorted(tuple(x) for x in spark.read.parquet(at["out"]).collect())
    rows = [x for a in arrivals for x in a]
    batch = stateful.drift_monitor(spark.createDataFrame(rows, SCHEMA), "k", "t", "id", "r", "10 minutes", 0.02, 1.5)
    passed = max(x[2] for x in rows) - LATE
    want = sorted(tuple(x) for x in batch.join(spark.createDataFrame(rows, SCHEMA).select("id", "t"), "id").where(F.col("t") < F.lit(passed)).select("k", "id", "up", "down", "alarm", "seen").collect())
    assert len(want) > 300 and any(x[4] for x in want)
    assert got == want


def test_quotes_are_captured_once_over_a_restart(spark, folders):
    arrivals, write, at = folders
    for k in range(4):
        write(k)
        again = spark.createDataFrame(arrivals[k][-5:], SCHEMA)  # the newest quotes come twice
        again.coalesce(1).write.mode("append").parquet(at["in"])
        stateful.drain_into(stateful.captured(stream(spark, at["in"]), ["id", "k"], "t", "10 minutes"), at["out"], at["state"])
    got = [x.id for x in spark.read.parquet(at["out"]).collect()]
    rows = [x for a in arrivals for x in a]
    assert len(got) == len(set(got)) == len(rows)
    batch = stateful.captured(spark.createDataFrame(rows + rows[:50], SCHEMA), ["id", "k"], "t", "10 minutes")
    assert sorted(x.id for x in batch.collect()) == sorted(got) and batch.columns == ["id", "k", "t", "r"]


def test_stale_quotes_are_set_apart(spark, folders):
    arrivals, write, at = folders
    write(0)
    mark = lambda df: stateful.staleness(df.withColumn("u", F.when(F.col("id") % 7 > 0, F.col("t") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 5 * 10 - 5).cast("int")))), "u", "t", 20)
    stateful.drain_into(mark(stream(spark, at["in"])), at["out"], at["state"])
    got = {x.id: x.rejected for x in spark.read.parquet(at["out"]).collect()}
    want = {i: "missing_update" if i % 7 == 0 else "future_update" if i % 5 == 0 else "stale" if i % 5 >= 3 else None for i, *_ in arrivals[0]}
    assert got == want == {x.id: x.rejected for x in mark(spark.createDataFrame(arrivals[0], SCHEMA)).collect()}


def test_the_session_is_left_as_it_was(spark):
    before = spark.conf.get(stateful._PROVIDER, None)
    with stateful.state_store(spark):
        assert spark.conf.get(stateful._PROVIDER) == stateful._ROCKS
    assert spark.conf.get(stateful._PROVIDER, None) == before
