"""Importance resampling and source mixing against plain loops, and awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import importance, mixing
from tidemark.llm.ordering import in_order, with_ranks, with_totals

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def by_hand(docs, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    out, may = [], []
    for i, (doc, text) in enumerate(docs):
        w, f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in map(bucket, f)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
        if len(w) >= least:
            may.append(i)
    may.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for k, i in enumerate(may[: percent * len(may) // 100]):
        out[i][4] = k + 1
    return Counter(map(tuple, out))


def test_resampling_of_awkward_texts(spark):
    long = "Straße ÉTÉ 東京 k9 " * 4000
    docs = [(i, f"Alpha beta{i % 3} gamma. " * (i % 9 + 3)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, " .,; \n"), (103, "one"), (104, long), (None, "delta epsilon " * 15), (105, "x" * 50_000), (106, "A_b-c d" * 9), (107, "\ttab\x0bwords and a b " * 7)]
    target = ["alpha beta1 gamma", None, "", "東京 K9 straße"]
    d = spark.createDataFrame([(*r, 7, "r") for r in docs], "doc_id long, text string, row int, bucket string").repartition(5)
    t = spark.createDataFrame([(x, 1) for x in target], "text string, k int")
    got = importance.resampled(d, t).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == by_hand(docs, target)
    assert all(k == "bigint" for _, k in got.dtypes)


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    docs = [(1, "a b c " * 10)] * 9 + [(2, "a b c " * 10)] * 3
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = d.limit(0)
    got = importance.resampled(d, t).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(k[:4] for k in by_hand(docs, []).elements())
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert importance.resampled(d.limit(0), d).count() == 0


def targets_by_hand(sizes, share=1.5, repeats=2, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, budget, target = set(names), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(w[s] for s in left)
        dry = {s for s in left if w[s] * level > repeats * sizes[s]}
        if not dry:
            return target | {s: w[s] * level for s in left}
        for s in dry:
            target[s] = float(repeats * sizes[s])
            budget -= target[s]
        left -= dry
    return target


@pytest.mark.parametrize("hot", [1, 40])
def test_mix_meets_its_targets(spark, hot):
    docs = [(i, "word " * (i * 37 % 91), f"s{i % 7}") for i in range(300)]
    docs += [(1000 + i, "ein Wort\xa0mehr " * (i % 13), "s3") for i in range(hot * 10)]
    docs += [(2000, None, "s1"), (2001, "", "é"), (2002, "a\x0bb\x0cc\td", None), (2003, "lang " * 30_000, None), (2004, " \n", "Z"), (None, "null id here", "s2"), (None, "null id here", "s2")]
    df = spark.createDataFrame([(*r, 5, "t") for r in docs], "doc_id long, text string, source string, size int, row string").repartition(6)
    got = mixing.mixed(df, (5, 2, 1), 1.5, 2).collect()
    size = lambda text: len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
    target = targets_by_hand(sizes)
    of = {i: (size(x), s) for i, x, s in docs}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in docs)
    taken = defaultdict(int)
    for r in got:
        n, source = of[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source]) and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 2 * n
        taken[source] += r.taken
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= len(sizes) for s in sizes)
    again = mixing.mixed(df.repartition(3, "doc_id"), (5, 2, 1), 1.5, 2).where("doc_id IS NOT NULL")
    assert Counter(again.collect()) == Counter(r for r in got if r.doc_id is not None)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.mixed(df).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    assert mixing.mixed(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b c d", "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mixed(one).collect()] == [(1, 4, 4, 6.0, 6)]


def test_a_source_that_runs_dry_leaves_its_share(spark):
    docs = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 1000, "c")]
    got = {r.doc_id: r for r in mixing.mixed(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert [got[i].target for i in (1, 2, 3)] == pytest.approx([20, 2 / 3 * 2995, 1 / 3 * 2995])
    assert got[1].taken == 20 and sum(got[i].taken for i in got) == 3015


def test_ranks_and_totals_over_parts(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 5 AS v").repartition(9)
    rows = in_order(df, [df.k.desc()], "t")
    assert {r.k: r["rank"] for r in with_ranks(rows).collect()} == {k: 1000 - k for k in range(1000)}
    v = {r.k: r.v for r in df.collect()}
    below = {r.k: r.below_v for r in with_totals(rows, ["v"]).collect()}
    assert all(below[k] == sum(v[j] for j in range(k + 1, 1000)) for k in range(0, 1000, 97))
