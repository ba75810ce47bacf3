"""Operators that SQL cannot express, against plain Python on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import decontaminate, media_chunks, ngram_join, packing, queries, suffix_dedup, token_blocks, toxicity
from tidemark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
AWKWARD = [(1000, None), (1001, ""), (1002, " \n "), (1003, "a" * 3000), (1004, "é" * 700), (1005, "x"), (None, "no id here"), (1006, "<|endoftext|> don't   stop\n\n 12345"), (1007, "twice twice"), (1007, "twice twice"), (1007, "other text")]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + AWKWARD


@pytest.fixture(scope="module")
def docs(spark, rows):
    # clashing names of columns that operators use inside
    return spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, row string, key int, n int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, row string")


def removed(rows, span):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + span] for _, t in texts for p in range(len(t) - span + 1))
    out = Counter()
    for i, t in texts:
        keep = bytearray(b"\1" * len(t))
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                keep[p : p + span] = bytes(span)
        kept = bytes(a for a, k in zip(t, keep) if k)
        out[i, len(t), len(t) - len(kept), len(re.findall(rb"\0+", bytes(keep))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_are_removed_exactly(docs, rows):
    assert Counter(map(tuple, suffix_dedup.remove_repeats(docs, 400).collect())) == removed(rows, 400)


@pytest.mark.parametrize("seed, span, most", [(0, 24, 20_000), (1, 24, 3), (2, 40, 20_000), (3, 130, 2)])
def test_repeats_in_low_entropy_texts(spark, seed, span, most):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab é"[: 2 + seed % 3]) for _ in range(rnd.randrange(400))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rnd.randrange(5)):
            b = rnd.choice(base)
            s = rnd.randrange(len(b) + 1)
            t += b[s : s + rnd.randrange(200)] + "".join(rnd.choice("abcdefgh\0") for _ in range(rnd.randrange(30)))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "a" * 500), (5, rows[5][1]), (6, "other " + rows[7][1]), (103, "\0" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffix_dedup.remove_repeats(df, span, most=most).collect())) == removed(rows, span)


def word_cuts(rows, span):
    """What is left of each text once every word of a repeated run of `span` words is gone."""
    found = [[(m.start(), m.group()) for m in re.finditer(r"[0-9A-Za-z_\u0080-\U0010ffff]+", t or "")] for _, t in rows]
    words = [[w.lower() for _, w in f] for f in found]
    seen = Counter(tuple(w[p : p + span]) for w in words for p in range(len(w) - span + 1))
    out = []
    for (i, t), f, w in zip(rows, found, words):
        gone = {k for p in range(len(w) - span + 1) if seen[tuple(w[p : p + span])] > 1 for k in range(p, p + span)}
        ends = [a for a, _ in f[1:]] + [len(t or "")]
        out.append((i, t if t is None else t[: f[0][0]] + "".join(t[a:b] for k, ((a, _), b) in enumerate(zip(f, ends)) if k not in gone) if f else t))
    return Counter(out)


@pytest.mark.parametrize("seed, span, most", [(0, 6, 20_000), (1, 8, 3), (2, 50, 20_000), (3, 50, 2)])
def test_repeated_runs_of_words_are_removed(spark, seed, span, most):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "Überall", "İx", "c-d", "e'f", "gh"]) + (str(rnd.randrange(50)) if rnd.random() < 0.9 else "")
    base = [[word() for _ in range(rnd.randrange(40, 120))] for _ in range(5)]
    rows = []
    for i in range(50):
        w = []
        for _ in range(rnd.randrange(4)):
            b = rnd.choice(base)
            a = rnd.randrange(len(b))
            w += [x.upper() if rnd.random() < 0.1 and x.isascii() else x for x in b[a : a + rnd.randrange(90)]] + [word() for _ in range(rnd.randrange(9))]
        rows.append((i, "".join(x + rnd.choice([" ", "\n", ", "]) for x in w)))
    rows += [(100, None), (101, ""), (102, "?! "), (103, "na " * 120), (3, rows[4][1]), (4, rows[4][1])]
    df = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, key string, n_chars int")
    got = suffix_dedup.without_repeats(df, span, "word", "n_chars", most)
    assert got.columns == df.columns
    got = got.collect()
    assert Counter((r.doc_id, r.text) for r in got) == word_cuts(rows, span)
    assert all(r.n_chars == 7 or r.n_chars == len(r.text) for r in got)


def repeated_words(rows, span):
    """How many words of each text lie in runs of `span` words that start anywhere else, too."""
    words = [re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (t or "").lower()) for _, t in rows]
    seen = Counter(tuple(w[p : p + span]) for w in words for p in range(len(w) - span + 1))
    return [len({k for p in range(len(w) - span + 1) if seen[tuple(w[p : p + span])] > 1 for k in range(p, p + span)}) for w in words]


@pytest.mark.parametrize("most", [20_000, 2])
def test_passages_of_over_50_words_are_counted_whatever_their_bytes(spark, most):
    rnd = random.Random(5)
    fresh = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(9999)}" for _ in range(n)]
    rows = []
    for i, n in enumerate([49, 50, 51, 55, 60, 51, 119]):
        passage = fresh(n)  # up to 60 words have less than 400 bytes
        rows += [(10 * i + j, " ".join(fresh(rnd.randrange(80)) + passage + fresh(rnd.randrange(80)))) for j in range(2 + i % 2)]
        rows.append((10 * i + 5, "\n".join(fresh(9) + [w.upper() for w in passage[: 50 + i]]) + "!"))
    twice = fresh(52)
    rows += [(100, None), (101, ""), (102, " ".join(fresh(300))), (103, " ".join(twice + fresh(3) + twice)), (104, "x" * 900), (105, "na " * 120), (106, rows[4][1]), (106, rows[4][1]), (106, "other " + rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, 400, most=most, words=50).collect()
    assert Counter(tuple(r)[:5] for r in got) == removed(rows, 400)
    assert Counter((r.doc_id, r.n_repeated_words) for r in got) == Counter((i, n) for (i, _), n in zip(rows, repeated_words(rows, 50)))
    # passages of 50 words and more in under 400 bytes: no byte string of 400 repeats, yet each document is marked
    short = [r for r in got if r.doc_id in (10, 11, 12, 20, 21, 30, 31, 32, 40, 41)]
    assert len(short) == 10 and all(r.n_repeated_words >= 50 for r in short) and any(r.n_removed == 0 for r in short)
    assert [r.n_repeated_words for r in got if r.doc_id in (0, 1, 100, 101, 102)] == [0] * 5


def test_op4_counts_words_of_repeated_runs(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op4_suffix_dedup(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == removed(rows, 400)
    assert Counter((r.doc_id, r.n_repeated_words) for r in got) == Counter((i, n) for (i, _), n in zip(rows, repeated_words(rows, 50)))


def shingles_of(text):
    w = re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (text or "").lower())
    return w, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows, similarity=0.8):
    """class id and number of links of every row, by comparing all pairs."""
    sets = [shingles_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, copies = [0] * len(rows), [1] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                same = sets[i][0] == sets[j][0]
                copies[i] += same
                copies[j] += same
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, least.get(root(i)), links[i], copies[i]) for i, (d, _) in enumerate(rows))


def edited(seed, n, words=120):
    """Near copies of one text, each with a few words of its own."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(words)] = f"v{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_every_link_is_found(spark, rows):
    more = rows + [(2000 + i, t) for i, t in enumerate(edited(1, 40) + edited(2, 7))] + [(3000, "A b, c d e!"), (3001, "a B c d E"), (3002, "a b c d e f")]
    df = spark.createDataFrame([(*r, 0) for r in more], "doc_id long, text string, words int")
    want = near(more)
    for block, whole in ((256, 4096), (8, 4096), (8, 5)):
        got = Counter(map(tuple, ngram_join.near_duplicates(df, block=block, whole=whole).collect()))
        assert got == want


def test_a_long_chain_of_weak_links(spark):
    rnd = random.Random(4)
    words, texts = [f"w{k}" for k in range(1400)], []
    for i in range(400):  # each shares most of its words with the next ones, few are near by the threshold
        own = words[3 * i : 3 * i + 60]
        texts.append(" ".join(own))
        if i % 50 == 0:
            own[rnd.randrange(60)] = "other"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, ngram_join.near_duplicates(df, block=32, whole=16).collect()))
    assert got == near(rows)


def test_one_of_each_class_stays(spark):
    texts = edited(3, 5) + ["alone in the world of words here", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    classes = {i: c for (i, c, *_), _ in near(list(enumerate(texts))).items()}
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in classes.items() if i == c)


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    assert bands * rows <= 128
    with pytest.raises(ValueError):
        ngram_join.banding(0.01, 0.999999)


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_the_library_s():
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import Encoder

    library, own, rnd = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path()), random.Random(3)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "don't", "it's", " 12", "Über", "naïve", "...", "—", "日本", "😀", "\t", "a", " the", "I'LL", "\u00a0", "\x1c", "_"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(2000)]
    got = own.encode(texts, 2)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids + [2], t


def test_packing_places_every_piece_once(docs, rows):
    got = packing.pack(docs, tokenizer_path(), 128, 2).collect()
    want, total = Counter(), 0
    for d, t in rows:
        ids = ids_of(t)
        total += len(ids)
        at, k = 0, 0
        while at < len(ids):
            to = at + ((len(ids) % 128 or 128) if k == 0 else 128)
            want[d, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at, k = to, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128
    print("sequences", len(seqs), "least", -(-total // 128))
    assert len(seqs) <= 1.01 * -(-total // 128)


def best_possible(sizes, capacity):
    """Fewest bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in sorted({b for b in bins if b >= sizes[i]}):
            k = bins.index(room)
            go(i + 1, bins[:k] + [room - sizes[i]] + bins[k + 1 :])
        go(i + 1, bins + [capacity - sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_the_optimum(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randrange(1, 31) for _ in range(11)]
    counts = np.bincount(sizes, minlength=31)
    plan = packing.bin_completion(counts, 30)
    placed = Counter()
    for shape, n in plan:
        assert sum(k * c for k, c in shape.items()) <= 30
        for k, c in shape.items():
            placed[k] += c * n
    assert placed == Counter(sizes)
    assert sum(n for _, n in plan) == best_possible(sizes, 30)


def test_more_nodes_are_never_worse():
    sizes = np.random.default_rng(0).integers(300, 500, 2000)
    counts = np.bincount(sizes, minlength=1025)
    used = []
    for nodes in (0, 10, 300):
        plan = packing.bin_completion(counts, 1024, nodes)
        placed = Counter()
        for shape, n in plan:
            assert sum(k * c for k, c in shape.items()) <= 1024
            for k, c in shape.items():
                placed[k] += c * n
        assert placed == Counter(sizes.tolist())
        used.append(sum(n for _, n in plan))
    assert used == sorted(used, reverse=True)
    assert used[0] <= 887


@pytest.mark.parametrize("seed", range(40))
def test_lower_bound_and_dominance(seed):
    rnd = random.Random(100 + seed)
    low = rnd.randrange(1, 15)
    sizes = [rnd.randrange(low, 31) for _ in range(9)]
    counts = np.bincount(sizes, minlength=31)
    best = best_possible(sizes, 30)
    assert packing.least_sequences(counts, 30) <= best
    first = packing.best_fit(counts, 30)
    assert sum(n for _, n in packing.branch_and_bound(counts, 30, first, 0, 10**6)) == best


def test_token_files_hold_all_ids(docs, rows):
    got = token_blocks.token_documents(docs, tokenizer_path(), 2).collect()
    want = Counter()
    for d, t in rows:
        ids = ids_of(t)
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    rolled = token_blocks.token_documents(docs, tokenizer_path(), 2, 20_000).collect()  # many files
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rolled) == want
    assert sorted(r.start for r in rolled) == sorted(r.start for r in got)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    for ids in (rnd.integers(0, 50257, n), np.zeros(n), np.where(rnd.random(n) < 0.05, 2**32 - 1, rnd.integers(0, 90, n)), rnd.integers(0, 2**32, n)):
        ids = ids.astype(np.uint32)
        blocks = token_blocks.encode_blocks(ids)
        starts = np.cumsum([0] + [len(b) for b in blocks[:-1]])
        assert (token_blocks.decode_blocks(b"".join(blocks), starts) == ids).all()


def test_media_is_rebuilt(docs, rows):
    got = media_chunks.chunked_media(docs).collect()
    want = Counter()
    for d, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    moved = media_chunks.chunked_media(docs, broadcast_bytes=-1).collect()  # the way for lists too large to broadcast
    assert Counter(map(tuple, moved)) == Counter(map(tuple, got))


def test_media_digests_are_of_the_stored_bytes(spark):
    rnd = random.Random(2)
    part = "".join(rnd.choice("abcdefghij klmn") for _ in range(40_000))
    df = spark.createDataFrame([(1, part), (2, "x" * 9000 + part), (3, part), (4, None), (5, part[:30_000] + "end"), (None, "short")], "doc_id long, text string")
    lists, _, owner, shared, store = media_chunks.stored_chunks(df)
    heads = {bytes(r.row): (bytes(r.head), bytes(r.z)) for r in store.where("row IS NOT NULL").collect()}
    lent = {bytes(r.digest): bytes(r.z) for r in store.where("digest IS NOT NULL").collect()}
    assert lent.keys() == {bytes(r.digest) for r in owner.collect()} and lent
    away = {}
    for r in sorted(shared.collect(), key=lambda r: r.place):
        away.setdefault(bytes(r.row), []).append(lent[bytes(r.digest)])
    got = {r.doc_id: r for r in media_chunks.chunked_media(df).collect()}
    for r in lists.collect():
        row = bytes(r.row)
        media = b"".join((*heads[row], *away.get(row, ())))
        assert (got[r.doc_id].media_bytes, got[r.doc_id].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    n, size, chunks = media_chunks.read_head(heads[bytes(lists.where("doc_id = 4").first().row)][0])
    assert (n, size, len(chunks)) == (0, 576, 1)


def test_equal_stretches_give_equal_chunks(spark):
    rnd = random.Random(5)
    long = "".join(chr(97 + rnd.randrange(26)) for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "start " + long), (3, long[:30_000] + "!" + long[30_000:])], "doc_id long, text string")
    lists = [r.chunks for r in df.selectExpr("unhex(md5(text)) row", "text").mapInArrow(media_chunks._list_rows, "key binary, n_bytes long, chunks array<struct<place:int,size:int,digest:binary>>").collect()]
    all_ = [bytes(c.digest) for chunks in lists for c in chunks]
    assert len(set(all_)) < 0.6 * len(all_)
    assert len(media_chunks.chunked_media(df).collect()) == 3


def local_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    rnd = np.random.default_rng(1)
    items = [rnd.integers(0, 4, rnd.integers(1, 12)) for _ in range(200)]
    texts = [rnd.integers(-1, 4, rnd.integers(1, 30)) for _ in range(200)]
    got, first, past = decontaminate.align(items, texts)
    for a, b, g, s, e in zip(items, texts, got, first, past):
        unknown = np.where(b < 0, 99, b)
        assert g == local_score(a.tolist(), unknown.tolist())
        assert g == local_score(a.tolist(), unknown[s:e].tolist())


def test_passages_of_benchmarks_are_found(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(12, 40)))) for i in range(20)] + [(50, None), (51, ""), (52, "Twowords only"), (7, "same id other words in this very item here")]
    docs, want = [], set()
    for d in range(60):
        text = [word() for _ in range(200)]
        if d % 3 == 0:
            i = rnd.randrange(20)
            copy = items[i][1].upper().split() if d % 2 else items[i][1].split()
            if d % 6 == 0:  # edited: every seventh word changed, one put in
                copy = [word() if k % 7 == 3 else w for k, w in enumerate(copy)]
                copy.insert(5, word())
            text[50:50] = copy
            want.add((d, i))
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "see Twowords, only!")]
    want.add((102, 52))
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, at int")
    for most in (4_000_000, 0):  # documents sifted in the scan, and not
        got = decontaminate.contaminated(df, bench, most_sift=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(0.5 <= r.score <= 1 for r in got)
    left = decontaminate.without_contaminated(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_common_words_and_very_long_items(spark):
    rnd = random.Random(11)
    common = [f"c{k}" for k in range(30)]
    short = [rnd.choice(common) for _ in range(14)]
    short[6] = "rareword"  # the copy has another word here
    long = [f"l{rnd.randrange(10**6)}" for _ in range(50_000)]
    texts = [" ".join(rnd.choice(common) for _ in range(3000)) for _ in range(20)]
    leak = " ".join(short[:6] + ["swapped"] + short[7:])
    book = " ".join(long[20_000:20_500])
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, "x y z " + leak + " u v"), (51, "p q " + book + " r"), (52, " ".join(long))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench, least=0.8).collect()}
    assert set(got) == {(50, 1), (51, 2), (52, 2)}
    assert got[52, 2] == 1.0


def test_all_pairs_over_the_threshold_are_found(spark):
    rnd = random.Random(21)
    word = lambda: f"w{int(rnd.paretovariate(0.6))}"
    items = [(i, [word() for _ in range(rnd.randrange(8, 25))]) for i in range(15)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rnd.randrange(5, 120))]
        if d % 2:
            copy = list(rnd.choice(items)[1])
            for _ in range(rnd.randrange(len(copy) // 3)):
                copy[rnd.randrange(len(copy))] = word()
            text[len(text) // 2 : len(text) // 2] = copy
        docs.append((d, text))
    want = {}
    for d, t in docs:
        for i, w in items:
            score = local_score(w, t) / (2 * len(w))
            if score >= 0.7:
                want[d, i] = score
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench, least=0.7).collect()}
    assert want and got == want


def test_edited_copies_at_half_the_score_are_found(spark):
    """Words changed, put in and left out at every second to eighth place, and short items: as all-pairs alignment says."""
    rnd = random.Random(33)
    word = lambda: f"w{int(rnd.paretovariate(0.8))}"
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 12, 20, 30, 31, 60])]
    edits = {
        "changed": lambda w, k: [word() if j % k == k - 1 else x for j, x in enumerate(w)],
        "put in": lambda w, k: [y for j, x in enumerate(w) for y in ((x, word()) if j % k == k - 1 else (x,))],
        "left out": lambda w, k: [x for j, x in enumerate(w) if j % k != k - 1],
    }
    docs = [[word() for _ in range(rnd.randrange(0, 40))] for _ in range(20)]
    for edit in edits.values():
        for k in (1, 2, 3, 4, 5, 8):
            for _, w in items[4:]:
                text = [word() for _ in range(rnd.randrange(30))]
                text[len(text) // 2 : len(text) // 2] = edit(w, k)
                docs.append(text)
    want = {}
    for d, t in enumerate(docs):
        for i, w in items:
            score = local_score(w, t) / (2 * len(w))
            if score >= 0.5:
                want[d, i] = score
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for most in (1000, 0):
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench, least=0.5, most_sift=most).collect()}
        assert got == want
    long = {p for p in want if len(items[p[1]][1]) > 6 and want[p] < 0.8}
    assert len(long) > 100


def test_whole_leaks_in_the_corpus_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: " ".join(re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (t or "").lower()))
    items = [(r.item_id, " " + words(r.text) + " ") for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in " " + words(r.text) + " "}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    assert want
    assert all(got.get(p) == 1.0 for p in want)
    assert {p for p, s in got.items() if s == 1.0} == want


def kernel(a, b):
    """The gapped kernel of two words by counting."""

    def sub(w):
        c = Counter()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 1 + toxicity.STEP)):
                for k in range(j + 1, min(len(w), j + 1 + toxicity.STEP)):
                    c[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return c

    x, y = sub(a), sub(b)
    norm = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    return sum(v * y[k] for k, v in x.items()) / norm**0.5 if norm else 0.0


def test_kernel_values():
    marks = ["insult", "pathetic", "achlichkeit", "anna"]
    words = ["insult", "ins.ult", "i-n-s-u-l-t", "insullt", "nsult", "path3tic", "banana", "unrelated", "ab", "", "éé", "achlichver", "insultinsult"]
    at, got = toxicity.Landmarks(marks).values(words)
    full = np.zeros((len(words), len(marks)))
    full[at] = got
    want = np.array([[kernel(w, m) for m in marks] for w in words])
    assert np.allclose(full, np.where(want < toxicity.FLOOR, 0, want))
    assert full[1, 0] > toxicity.FLOOR and full[3, 0] > toxicity.FLOOR


def test_scores_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id")
    got = toxicity.score(some, toxicity.train(docs, labels)).join(labels, "doc_id").where("pmod(crc32(cast(doc_id AS string)), 5) = 0").select("score", "predicted", "toxic").toPandas()
    up, down = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = (up[:, None] > down[None]).mean() + 0.5 * (up[:, None] == down[None]).mean()
    print("AUC", auc, "accuracy", (got.predicted == got.toxic).mean(), "recall", (up >= 0.5).mean(), "false alarms", (down >= 0.5).mean())
    assert auc > 0.95 and (got.predicted == got.toxic).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_scores_without_labels_or_text(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert got.count() == docs.count() and got.where("score <> 0").count() == 0
    assert toxicity.without_toxic(none, labels).columns == none.columns


@pytest.mark.parametrize("f", [
    lambda d: suffix_dedup.remove_repeats(d), lambda d: ngram_join.near_duplicates(d), lambda d: packing.pack(d, tokenizer_path()),
    lambda d: token_blocks.token_documents(d, tokenizer_path()), lambda d: media_chunks.chunked_media(d),
    lambda d: decontaminate.contaminated(d, d.sparkSession.createDataFrame([(1, "some words here")], "item_id long, text string")),
    lambda d: ngram_join.one_of_each(d),
])
def test_empty_tables(none, f):
    assert f(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    from tidemark.llm.common import components

    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 100 + i) for i in range(50)] + [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)] + [(7, None), (None, 8), (900, 900)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
