"""The pipeline's stages on awkward tables, and each of them, and the run, against brute force."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontaminate, toxicity
from tidemark.llm.common import written
from tidemark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
ROWS = [(1, "a b c", "k", 3, 9), (None, None, None, 0, 8), (2, "", "k", 0, 7)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[1:4])
def test_clashing_columns_and_nulls_stay(spark, name, stage):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, row string, n_chars int, doc int")
    out = stage(spark, df, SF)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(ROWS, key=str)


WORD = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def classes(docs):
    """The least id of each class of texts that are alike by word 5-shingles, over all pairs."""
    sets = {}
    for r in docs:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)):
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i for i in sets if find(i) == i or not sets[i]}


def uncovered(docs, n=50):
    """Words outside of every run of n words that starts twice or more."""
    lists = {r.doc_id: words(r.text) for r in docs}
    times = Counter(tuple(w[i : i + n]) for w in lists.values() for i in range(len(w) - n + 1))
    out = {}
    for k, w in lists.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if times[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out[k] = [x for i, x in enumerate(w) if i not in gone]
    return out


def leaking(docs, items):
    """Ids of texts with a passage that aligns with an item at half the score or more, over all pairs."""
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    tests = [code(words(r.text)) for r in items if words(r.text)]
    texts = {r.doc_id: code(words(r.text)) for r in docs if words(r.text)}
    found = set()
    for k, t in texts.items():
        for at in range(0, len(tests), 20):
            some = tests[at : at + 20]
            score, _, _ = decontaminate.align(some, [t] * len(some))
            if any(s >= len(i) for s, i in zip(score, some)):  # 2 a word: half is one a word
                found.add(k)
                break
    return found


def test_every_stage_against_brute_force_and_the_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.collect()
        kept = written(stage(spark, kept, SF), f"test-{name}")
        after = kept.collect()
        ids = {r.doc_id for r in after}
        assert kept.columns == columns and len(ids) == len(after)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
        elif name == "ngram_jaccard_join":
            want = classes(before)
        elif name == "suffix_array_dedup":
            want = {r.doc_id for r in before}
            assert {r.doc_id: words(r.text) for r in after} == uncovered(before)
        else:
            want = {r.doc_id for r in before} - leaking(before, bench)
        assert ids == want, name
        if name != "suffix_array_dedup":
            texts = {r.doc_id: r for r in before}
            assert all(texts[r.doc_id] == r for r in after)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    code = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: [*code.encode(r.text or "", add_special_tokens=False).ids, 2] for r in after}
    pieces, places = {}, {}
    for r in last:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for k, own in ids.items():
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at
            at += length
        assert at == len(own) and (len(own) > 1024 or len(pieces[k]) == 1)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert pieces.keys() == ids.keys()
    run = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, last)) and len({r.sequence_id for r in run}) == len(places)
