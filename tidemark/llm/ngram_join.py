"""N-gram Jaccard self-join of documents by MinHash banding.

Signatures are cut into bands; documents that agree on a band hash become candidates through the least document
of the bucket, so a bucket of m documents yields m - 1 edges, not all pairs. Small components of candidates are
verified whole. Boilerplate can chain very many documents by weak links: in components of over `whole` documents
the shuffle goes by band hash, each pair is looked at in the first band it shares, and only rows that have a partner
by the estimate from whole signatures go on to verification. Groups are dealt into blocks, and each pair of blocks is
verified in one task on the full n-gram sets: a pair counts if it agrees on at least one band and its Jaccard
similarity reaches the threshold. A group of any size is split over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, hot_join, mix, row_key, runs, shingles, signed, slices, tasks, word_hashes, written


def banding(similarity: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows per band): the most selective split of `hashes` that finds a pair at `similarity` with `recall`."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    raise ValueError(f"{hashes} hashes can't reach recall {recall} at similarity {similarity}")


def least_agreement(similarity: float, hashes: int, missed: float = 1e-9) -> int:
    """How many of `hashes` values agree at least for a pair at `similarity`, but for a share `missed` of such pairs."""
    below, k = 0.0, 0
    while True:
        below += math.comb(hashes, k) * similarity**k * (1 - similarity) ** (hashes - k)
        if below > missed:
            return k
        k += 1


def signatures(sh: np.ndarray, off: np.ndarray, hashes: int) -> np.ndarray:
    """rows x hashes MinHash values; rows must not be empty."""
    seeds = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(off) - 1, hashes), np.uint32)
    at = 0
    while at < len(off) - 1:  # runs of rows that stay in the CPU's cache
        to = max(at + 1, int(np.searchsorted(off, off[at] + 16_384, side="right")) - 1)
        part, cuts = sh[off[at] : off[to]], off[at:to] - off[at]
        for k in range(hashes):
            v = part * seeds[k]
            v >>= np.uint64(32)
            out[at:to, k] = np.minimum.reduceat(v, cuts)
        at = to
    return out


def _signature_rows(n: int, bands: int, rows: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words, off, _ = word_hashes(batch.column(1))
            some = np.diff(off) > 0
            sh, to = shingles(words, off, n)
            count = np.diff(to)
            cuts = np.concatenate(([0], np.cumsum(count[some])))
            sig = signatures(sh, cuts, bands * rows).astype(np.uint64)
            band = np.zeros((len(sig), bands), np.uint64)
            for b in range(bands):
                h = np.full(len(sig), b + 1, np.uint64)
                for r in range(rows):
                    h = mix(h ^ sig[:, b * rows + r]) + np.uint64(r)
                band[:, b] = h
            # rows without a word have no n-grams: no text hash and no band
            digests = [xxhash.xxh3_128_digest(words[i:j].tobytes()) for i, j in zip(off[:-1][some].tolist(), off[1:][some].tolist())]
            text, flat = np.full(len(some), None, object), np.concatenate(([0], np.cumsum(some * bands)))
            text[some] = digests
            short = np.full(len(some), None, object)
            short[some] = [v.tobytes() for v in sig.astype("<u2")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(text, pa.binary()), pa.ListArray.from_arrays(pa.array(flat, pa.int32()), pa.array(signed(band.ravel()))), pa.array(short, pa.binary())],
                ["row", "doc_id", "words", "bands", "sig"],
            )

    return run


def _set_rows(n: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words, off, _ = word_hashes(batch.column(1))
            sh, to = shingles(words, off, n)
            sets = [np.unique(signed(sh[i:j])) for i, j in zip(to[:-1], to[1:])]
            flat = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            grams = pa.ListArray.from_arrays(pa.array(flat, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4)), grams], ["row", "places", "copies", "bands", "grams"])

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j] for the pairs (i, j); sets are sorted and distinct."""
    i, j = pairs
    if len(i) <= 64 or len(i) * 8 < len(a) * len(b):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    both = np.unique(np.concatenate(a + b))
    inter = np.zeros((len(a), len(b)), np.float32)
    place = [[np.searchsorted(both, s) for s in side] for side in (a, b)]
    for at in range(0, len(both), 4096):  # bounded by columns, whatever the texts' length
        dense = []
        for side in place:
            m = np.zeros((len(side), 4096), np.float32)
            for r, p in enumerate(side):
                m[r, p[np.searchsorted(p, at) : np.searchsorted(p, at + 4096)] - at] = 1
            dense.append(m)
        inter += dense[0] @ dense[1].T
    return np.rint(inter[i, j]).astype(np.int64)


GROUP = ["group", "band", "low", "high"]


def _blocks(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of blocks: its rows, the places of either block's rows, and which pairs of them to look at.

    A row comes once, though rows that are equal in id and text may repeat. A pair is looked at if it shares a band; in
    a group that is a bucket (band >= 0), if that is the first band it shares.
    """
    keys = np.stack([t.column(c).to_numpy() for c in (*GROUP, "block", "row")], 1)
    new = np.ones(len(keys), bool)
    new[1:] = np.any(keys[1:] != keys[:-1], axis=1)
    t, keys = t.filter(pa.array(new)), keys[new]
    edges = np.flatnonzero(np.any(keys[1:, :4] != keys[:-1, :4], axis=1)) + 1
    bands = np.stack(t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)) if len(keys) else np.zeros((0, 0), np.int64)
    for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))):
        _, band, low, high = keys[lo, :4].tolist()
        a = np.flatnonzero(keys[lo:hi, 4] == low)
        b = a if low == high else np.flatnonzero(keys[lo:hi, 4] == high)
        if not len(a) or not len(b) or (low == high and len(a) < 2):
            continue
        ba, bb = bands[lo + a], bands[lo + b]
        hit = np.zeros((len(a), len(b)), bool)
        for k in range(bands.shape[1] if band < 0 else band):
            hit |= ba[:, k, None] == bb[None, :, k]
        hit = hit if band < 0 else ~hit
        if low == high:
            hit = np.triu(hit, 1)
        if hit.any():
            yield t.slice(lo, hi - lo), a, b, hit


def _sift_rows(similarity: float, hashes: int):
    """Rows of a bucket that have a partner as far as signatures tell."""
    need = least_agreement(similarity, hashes)

    def run(batches):
        for t in runs(batches, GROUP, 256):
            for part, a, b, hit in _blocks(t):
                sig = np.stack([np.frombuffer(v, "<u2") for v in part.column("sig").to_pylist()])
                sa, sb = sig[a], sig[b]
                ok = np.zeros(hit.shape, bool)
                for i in np.flatnonzero(hit.any(1)):
                    ok[i] = hit[i] & ((sa[i] == sb).sum(1) >= need)
                on = np.zeros(part.num_rows, bool)
                on[a[ok.any(1)]] = True
                on[b[ok.any(0)]] = True
                if on.any():
                    yield part.filter(pa.array(on)).select([*GROUP, "block", "row"]).combine_chunks().to_batches()[0]

    return run


def _verify_rows(similarity: float):
    def run(batches):
        for t in runs(batches, GROUP, 256):
            for part, a, b, hit in _blocks(t):
                row, copies, grams = part.column("row").to_numpy(), part.column("copies").to_numpy(), part.column("grams").combine_chunks()
                i, j = np.nonzero(hit)
                sa, sb = ([grams[int(x)].values.to_numpy() for x in side] for side in (a, b))
                inter = overlaps(sa, sb, (i, j))
                union = np.array([len(s) for s in sa])[i] + np.array([len(s) for s in sb])[j] - inter
                ok = inter >= similarity * union - 1e-9
                x, y = a[i[ok]], b[j[ok]]
                links = np.bincount(x, copies[y], len(row)) + np.bincount(y, copies[x], len(row))
                label = np.arange(len(row))
                while True:  # least member that the block's links reach
                    new = label.copy()
                    np.minimum.at(new, x, label[y])
                    np.minimum.at(new, y, label[x])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(row[on]), pa.array(links[on].astype(np.int64)), pa.array(row[label[on]])], ["row", "links", "root"])

    return run


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999999, block: int = 256, whole: int = 4096) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies.

    docs: doc_id, text; other columns are ignored, whatever their names. Texts are compared as sets of n-word shingles
    of lower-cased words; a text of fewer words has one shingle of all of them. Links join documents whose sets'
    Jaccard similarity is at least `similarity`. class_id is the least doc_id of the documents that links connect,
    n_links the number of other documents linked to this one (copies of a text count one by one), n_copies the
    documents with the same words. A null or wordless text links to nothing and is its own class (a null id too).
    Rows that repeat id and text count as copies. An empty table gives an empty result.
    """
    out = _grouped(docs, n, similarity, recall, block, whole)
    least = written(out.groupBy("group").agg(F.min("doc_id").alias("class_id")), "classes")
    return out.join(least, "group").select("doc_id", "class_id", "n_links", "n_copies")


def _grouped(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999999, block: int = 256, whole: int = 4096) -> DataFrame:
    """(row, doc_id, group, n_links, n_copies): one row per document, with its row key and the group that links give it."""
    bands, rows = banding(similarity, recall)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row_key("doc_id", "text"))
    id_type = dict(docs.dtypes)["doc_id"]
    sig = written(base.select("row", "text", "doc_id").mapInArrow(_signature_rows(n, bands, rows), f"row long, doc_id {id_type}, words binary, bands array<long>, sig binary"), "signatures")
    texts = sig.where("words IS NOT NULL").groupBy("words").agg(F.min_by(F.struct("row", "bands", "sig"), "row").alias("at"), F.count("*").alias("copies"))
    texts = written(texts.select("words", "at.row", "at.bands", "at.sig", "copies"), "texts")
    band = texts.select("row", F.explode("bands").alias("band"))
    bucket = band.groupBy("band").agg(F.min("row").alias("least"), F.count("*").alias("m")).where("m > 1").select("band", "least")
    # a row points at the least of its buckets' documents, and so do they: a few edges for each row at most
    least = band.join(written(bucket, "buckets"), "band").groupBy("row").agg(F.collect_set("least").alias("all")).select("row", "all", F.array_min("all").alias("dst"))
    near = components(least.select(F.explode(F.array_union(F.array("row"), "all")).alias("src"), "dst").distinct())
    sizes = written(near.groupBy("component").agg(F.count("*").alias("m")), "component-sizes")
    near = written(hot_join(near.withColumnRenamed("node", "row"), sizes, ["component"], "m", "inner"), "candidates")

    def dealt(df: DataFrame, group: str) -> DataFrame:
        """(group, band, low, high, block) of each row: its block's pairs with all blocks of its group of `m` rows."""
        df = df.withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
        df = df.withColumn("block", F.pmod(F.xxhash64("row", group), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        return df.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).withColumnRenamed(group, "group")

    place = [*GROUP, "block", "row"]
    places = dealt(near.where(F.col("m") <= whole).withColumn("band", F.lit(-1)), "component").select(*place)
    chained = near.where(F.col("m") > whole)
    if not chained.isEmpty():
        each = chained.select("row").join(texts.select("row", "bands", "sig"), "row").select("row", "bands", "sig", F.posexplode("bands").alias("band", "hash"))
        shared = written(each.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1"), "chained-buckets")
        sifted = dealt(hot_join(each, shared, ["hash"], "m", "inner"), "hash").select(*place, "bands", "sig").repartition(tasks(docs), "group", "low", "high")
        sifted = sifted.sortWithinPartitions(*place).mapInArrow(_sift_rows(similarity, bands * rows), "group long, band int, low int, high int, block int, row long")
        places = places.unionByName(written(sifted, "sifted"))
    held = places.groupBy("row").agg(F.collect_list(F.struct(*place[:-1])).alias("places"))
    held = held.join(texts.select("row", "bands", "copies"), "row")
    sets = base.select("row", "text").join(held.hint("shuffle_hash"), "row").select("row", "text", "places", "copies", "bands")
    sets = sets.mapInArrow(_set_rows(n), f"row long, places {held.schema['places'].dataType.simpleString()}, copies long, bands array<long>, grams array<long>")
    sets = sets.select("row", F.explode("places").alias("at"), "copies", "bands", "grams").select("at.*", "row", "copies", "bands", "grams")
    verified = sets.repartition(tasks(docs), "group", "low", "high").sortWithinPartitions(*place).mapInArrow(_verify_rows(similarity), "row long, links long, root long")
    verified = written(verified, "verified")
    links = verified.groupBy("row").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("row").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "row")
    of_text = texts.join(links, "row", "left").join(groups, "row", "left")
    of_text = of_text.select("words", F.coalesce("component", "row").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    out = sig.where("words IS NOT NULL").select("row", "doc_id", "words").join(of_text, "words").select("row", "doc_id", "group", "n_links", "n_copies")
    out = out.unionByName(sig.where("words IS NULL").select("row", "doc_id", F.col("row").alias("group"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
    return written(out, "grouped")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without near-duplicates: of each class the row with the least doc_id stays (of rows that share that id, one).

    Keeps all columns. Rows are told apart by id and text, so that each has its own decision; rows without an id come
    last in their class. Wordless texts stay.
    """
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    keep = _grouped(docs, **how).groupBy("group").agg(F.min_by("row", first).alias("row")).select("row")
    some = F.coalesce("text", F.lit("")).rlike(r"[0-9A-Za-z_\x{80}-\x{10FFFF}]")
    keyed = docs.where(some).select(row_key("doc_id", "text").alias("row"), F.struct("*").alias("doc"))  # no name in docs can clash
    kept = keyed.join(keep, "row", "left_semi").groupBy("row").agg(F.first("doc").alias("doc"))
    return kept.select("doc.*").unionByName(docs.where(~some))
