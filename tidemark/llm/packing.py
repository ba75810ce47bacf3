"""Packing of tokenised documents into fixed-length sequences by bin completion.

Only the number of pieces of each length matters for a plan, and there are at most `capacity` lengths, so the
search runs on that histogram, whatever the corpus size. Best-fit decreasing is the first incumbent. A plan completes
the sequence of the largest piece left, again and again: sums that the pieces left can reach are known, so fillings
of a given waste are enumerated without dead ends; dominated ones are passed over, and a plan is given up once its
waste says that it can't beat the incumbent. Dives take one filling at each step, as often as the counts allow; after
them a branch and bound over all undominated fillings of single sequences goes on for a stated number of nodes.
Pieces then find their places by their rank among pieces of their length, which is counted without gathering a length
in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, tasks, written
from tidemark.llm.tokens import encoder

Plan = list[tuple[dict[int, int], int]]  # (pieces of each length in a sequence, number of such sequences)


class Reach:
    """Which sums up to `room` the pieces of a histogram have, as bits, by the largest length used."""

    def __init__(self, left: np.ndarray, room: int):
        self.left, self.room = left, room
        self.sizes = (np.flatnonzero(left[: room + 1])).tolist()
        self.counts = left[self.sizes].tolist()
        mask = (2 << room) - 1
        self.below = [1]  # below[j]: sums without the lengths from place j on
        for x, c in zip(self.sizes, self.counts):
            sums, n, step = self.below[-1], min(c, room // x), 1
            while n > 0:
                take = min(step, n)
                sums |= (sums << (take * x)) & mask
                n, step = n - take, step * 2
            self.below.append(sums)

    def fillings(self, total: int, at: int | None = None) -> Iterator[list[int]]:
        """Every set of pieces, largest first, whose lengths add up to `total`; large pieces are tried first."""
        if not total:
            yield []
            return
        at = min(len(self.sizes) if at is None else at, bisect_right(self.sizes, total))
        for j in range(at - 1, -1, -1):
            x = self.sizes[j]
            for t in range(min(self.counts[j], total // x), 0, -1):
                if self.below[j] >> (total - t * x) & 1:
                    for rest in self.fillings(total - t * x, j):
                        yield [x] * t + rest
            if not self.below[j] >> total & 1:
                return

    def least_waste(self) -> int:
        return self.room + 1 - self.below[-1].bit_length()

    def dominated(self, chosen: list[int], waste: int) -> bool:
        """Whether a piece left fits besides, or may stand for one or two of the chosen with as good an end."""
        spare = Counter(chosen)
        free = [x for x, c in zip(self.sizes, self.counts) if c > spare[x]]

        def between(low: int, high: int) -> bool:
            k = bisect_right(free, low)
            return k < len(free) and free[k] <= high

        if between(0, waste):
            return True
        return any(between(y, y + waste) for y in spare) or any(between(chosen[i] + chosen[k] - 1, chosen[i] + chosen[k] + waste) for i in range(len(chosen)) for k in range(i))


def wasteless(reach: Reach, exact: int) -> list[int]:
    """Of up to `exact` fillings of least waste the one that can be repeated most often, which uses up plentiful lengths."""
    some = list(islice(reach.fillings(reach.room - reach.least_waste()), exact))
    return max(some, key=lambda f: min((int(reach.left[x]) // k for x, k in Counter(f).items()), default=0))


def sparing(left: np.ndarray, room: int, price: float, most: int = 6) -> list[int]:
    """The filling of at most `most` pieces that has the least waste plus `price` a piece: small pieces are kept for
    where they save a whole sequence."""
    sizes = np.flatnonzero(left[: room + 1]).tolist()
    mask = (2 << room) - 1
    table = [[1] + [0] * most]  # sums by the number of pieces, without the lengths from a place on
    for x in sizes:
        now = list(table[-1])
        for _ in range(min(int(left[x]), room // x, most)):
            for k in range(most, 0, -1):
                now[k] |= (now[k - 1] << x) & mask
        table.append(now)
    k = min((k for k in range(most + 1) if table[-1][k]), key=lambda k: (room + 1 - table[-1][k].bit_length() + price * k, k))
    total, out = table[-1][k].bit_length() - 1, []
    for j in range(len(sizes), 0, -1):
        x = sizes[j - 1]
        t = next(t for t in range(k + 1) if total >= t * x and t <= left[x] and table[j - 1][k - t] >> (total - t * x) & 1)
        out += [x] * t
        total, k = total - t * x, k - t
    return out


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on the histogram."""
    open_: dict[int, dict[tuple, int]] = {}
    for x in range(capacity, 0, -1):
        n = int(counts[x])
        while n:
            room = next((r for r in range(x, capacity) if open_.get(r)), capacity)
            group = open_.get(room, {})
            shape, have = next(iter(group.items())) if group else ((), n)
            take = min(n, have)
            if group:
                group[shape] -= take
                if not group[shape]:
                    del group[shape]
            to = open_.setdefault(room - x, {})
            to[shape + (x,)] = to.get(shape + (x,), 0) + take
            n -= take
    return [(dict(Counter(shape)), n) for group in open_.values() for shape, n in group.items()]


def dive(counts: np.ndarray, capacity: int, most: int, choose) -> Plan | None:
    """Around the largest piece left one filling, as often as the counts allow, until none is left; None once the
    plan needs over `most` sequences, which its waste tells."""
    left, plan = counts.astype(np.int64).copy(), []
    allow = most * capacity - int(left @ np.arange(capacity + 1))
    for x in range(capacity, 0, -1):
        while left[x]:
            left[x] -= 1
            need = Counter([x, *choose(left, capacity - x)])
            left[x] += 1
            n = min(int(left[k]) // c for k, c in need.items())
            allow -= n * (capacity - sum(k * c for k, c in need.items()))
            if allow < 0:
                return None
            for k, c in need.items():
                left[k] -= n * c
            plan.append((dict(need), n))
    return plan


def branch_and_bound(counts: np.ndarray, capacity: int, plan: Plan, least: int, nodes: int) -> Plan:
    """The best plan met within `nodes` fillings tried; more nodes go on from there, so they never give a worse one.

    The bound: what all sequences may waste in a plan with one sequence less than the incumbent's.
    """
    used, total = sum(n for _, n in plan), int(counts @ np.arange(capacity + 1))
    left, seen = counts.astype(np.int64).copy(), 0
    path: list[list[int]] = []
    spent = 0  # waste on the path

    def options() -> Iterator[list[int]]:
        x = int(np.flatnonzero(left)[-1])
        left[x] -= 1
        reach = Reach(left.copy(), capacity - x)
        left[x] += 1
        for waste in range(reach.least_waste(), capacity - x + 1):
            if spent + waste > (used - 1) * capacity - total:
                return
            if reach.below[-1] >> (capacity - x - waste) & 1:
                for f in reach.fillings(capacity - x - waste):
                    if not reach.dominated(f, waste):
                        yield [x, *f]

    stack = [options()] if left.any() else []
    while stack and used > least and seen < nodes:
        chosen = next(stack[-1], None)
        if chosen is None:
            stack.pop()
            if path:
                old = path.pop()
                spent -= capacity - sum(old)
                np.add.at(left, old, 1)
            continue
        if spent + capacity - sum(chosen) > (used - 1) * capacity - total:
            continue
        seen += 1
        path.append(chosen)
        spent += capacity - sum(chosen)
        np.subtract.at(left, chosen, 1)
        if left.any():
            stack.append(options())
            continue
        if len(path) < used:
            used = len(path)
            plan = [(dict(Counter(f)), n) for f, n in Counter(map(tuple, path)).items()]
        old = path.pop()
        spent -= capacity - sum(old)
        np.add.at(left, old, 1)
    return plan


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: by the total, and by pieces that can't share a sequence with each other."""
    size = np.arange(capacity + 1)
    best = -(-int(counts @ size) // capacity)
    up, sums = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * size)
    for k in range(1, capacity // 2 + 1):  # pieces over capacity - k stand without those of k or more
        alone, wide = int(up[capacity - k + 1]) if k else 0, int(up[capacity // 2 + 1])
        half = wide - alone
        middle = int(sums[capacity // 2] - sums[k - 1])
        room = half * capacity - int(sums[capacity - k] - sums[capacity // 2])
        best = max(best, alone + half + max(0, -(-(middle - room) // capacity)))
    return best


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 2_000) -> Plan:
    """The plan of fewest sequences met; every piece is placed exactly once. It ends at the lower bound, or after all
    dives and `nodes` fillings of the branch and bound; small instances end there with proof."""
    plan, least = best_fit(counts, capacity), least_sequences(counts, capacity)
    ways = [lambda left, room, e=exact: wasteless(Reach(left, room), e) for exact in (1, 2, 4, 8, 16, 64)]
    ways += [lambda left, room, p=capacity * k / 32: sparing(left, room, p) for k in (2, 4, 5, 6, 7, 8, 9, 10, 12)]
    for choose in ways:
        used = sum(n for _, n in plan)
        if used <= least:
            return plan
        plan = dive(counts, capacity, used - 1, choose) or plan
    return branch_and_bound(counts, capacity, plan, least, nodes)


def _piece_rows(path: str, end: int, capacity: int):
    def run(batches):
        code = encoder(path)
        for batch in slices(batches, "text"):
            own, piece, start, length, crc = ([] for _ in range(5))
            for i, ids in enumerate(code.encode(batch.column(1).to_pylist(), end)):
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:  # the first piece takes what whole pieces leave over
                    to = at + ((n % capacity or capacity) if k == 0 else capacity)
                    own.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * to]))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place_rows(plan: Plan):
    """plan: at most a few patterns per length, so it goes to the tasks as it is."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank, base = Counter(), 0
    for shape, n in plan:
        offset = 0
        for x in sorted(shape, reverse=True):
            runs.setdefault(x, []).append((rank[x], shape[x], base, offset))
            rank[x] += shape[x] * n
            offset += shape[x] * x
        base += n
    table = {x: tuple(np.array(c) for c in zip(*r)) for x, r in runs.items()}

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                on = np.flatnonzero(length == x)
                first, each, base, offset = table[int(x)]
                at = np.searchsorted(first, rank[on], side="right") - 1
                k = rank[on] - first[at]
                seq[on] = base[at] + k // each[at]
                off[on] = offset[at] + k % each[at] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [*names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id, text; other columns are ignored, whatever their names. A null or empty text is one piece of the end
    id alone. Documents of more than `capacity` ids are cut into whole pieces, the first taking the remainder; others
    are never cut. Rows that repeat are packed as often as they come. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    pieces = docs.select("doc_id", "text").mapInArrow(_piece_rows(tokenizer, end, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = written(pieces, "pieces")
    lanes = pieces.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(tasks(docs))).cast("int"))
    sizes = written(lanes.groupBy("length", "lane").agg(F.count("*").alias("n")), "sizes")  # capacity x lanes rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "lane", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = lanes.withColumn("own", own).join(offsets, ["length", "lane"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place_rows(bin_completion(counts, capacity)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
