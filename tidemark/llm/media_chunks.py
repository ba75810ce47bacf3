"""Content-defined chunks for media payloads.

A rolling gear hash cuts payloads, so equal stretches give equal chunks wherever they stand. Chunk digests are
deduplicated by joins: each distinct chunk has one owner, the least (row, place). A document's store row holds its head
(a header and the ordered chunk list) and the packed bytes of the chunks it owns; the other chunks are fetched by
digest. Payloads are rebuilt from the store and every chunk and payload is verified on the way. What lies in the store
for a payload, its head and all packed chunks that it is rebuilt from, is its stored form.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hot_join, mix, slices, text_bytes, written

GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
LEAST, MEAN_BITS, MOST = 1024, 12, 16384
UNIT = 576
HEAD = "<4sQQI"  # magic, text bytes, payload bytes, chunks


def gear_cuts(data: np.ndarray, off: np.ndarray, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[list[int]]:
    """For each row its chunk ends, relative to the row's start.

    The hash at a byte covers the 32 bytes up to it, and `least` is at least 32, so a cut depends on the row alone.
    """
    h = GEAR[data]
    size = 1
    while size < 32:  # h[i] = sum of gear[i - j] << j over j < 32, by doubling
        g = h.copy()
        g[size:] += h[:-size] << np.uint32(size) if len(h) > size else 0
        h = g
        size *= 2
    spot = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    first = np.searchsorted(spot, off[:-1], side="right")
    past = np.searchsorted(spot, off[1:], side="right")
    out = []
    for i in range(len(off) - 1):
        a, n = int(off[i]), int(off[i + 1] - off[i])
        ends, last = [], 0
        for s in (spot[first[i] : past[i]] - a).tolist():
            while s - last > most:
                last += most
                ends.append(last)
            if s - last >= least:
                ends.append(s)
                last = s
        while n - last > most:
            last += most
            ends.append(last)
        if last < n:
            ends.append(n)
        out.append(ends)
    return out


def payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded with bytes 255 to a positive multiple of 576: bytes, offsets, unpadded lengths."""
    data, off = text_bytes(column)
    n = np.diff(off)
    size = np.maximum(1, -(-n // UNIT)) * UNIT
    to = np.concatenate(([0], np.cumsum(size)))
    out = np.full(to[-1], 255, np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - off[:-1], n)] = data
    return out, to, n


def _list_rows(batches):
    for batch in slices(batches, "text"):
        data, off, n = payloads(batch.column(1))
        lists = []
        for i, ends in enumerate(gear_cuts(data, off)):
            p = data[off[i] : off[i + 1]]
            lists.append([{"place": k, "size": e - s, "digest": hashlib.sha256(p[s:e]).digest()} for k, (s, e) in enumerate(zip([0, *ends], ends))])
        kind = pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(lists, kind)], ["key", "n_bytes", "chunks"])


def _store_rows(batches):
    pack = zstandard.ZstdCompressor(level=6)
    for batch in slices(batches, "text"):
        data, off, n = payloads(batch.column(1))
        out: list[tuple] = []
        for i, (row, ends, lent, foreign) in enumerate(zip(batch.column(0).to_pylist(), gear_cuts(data, off), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            p = data[off[i] : off[i + 1]]
            cuts = list(zip([0, *ends], ends))
            skip = {*(foreign or ()), *(lent or ())}
            own = b"".join(p[s:e].tobytes() for k, (s, e) in enumerate(cuts) if k not in skip)
            digests = [hashlib.sha256(p[s:e]).digest() for s, e in cuts]
            head = struct.pack(HEAD, b"CDC1", int(n[i]), len(p), len(cuts)) + b"".join(struct.pack("<I", e - s) + d for (s, e), d in zip(cuts, digests))
            out.append((row, None, bool(skip), head, pack.compress(own)))
            for k in lent or ():
                s, e = cuts[k]
                out.append((None, digests[k], False, None, pack.compress(p[s:e].tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _STORE_TYPES)], _STORE_NAMES)


_STORE_NAMES = ["row", "digest", "parted", "head", "z"]
_STORE_TYPES = [pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
_STORE = "row binary, digest binary, parted boolean, head binary, z binary"


def read_head(head: bytes) -> tuple[int, int, list[tuple[int, bytes]]]:
    """Unpadded and padded length, and (size, digest) of each chunk in order."""
    magic, n, size, count = struct.unpack_from(HEAD, head)
    at = struct.calcsize(HEAD)
    if magic != b"CDC1" or len(head) != at + 36 * count:
        raise ValueError("not the head of a stored payload")
    return n, size, [(struct.unpack_from("<I", head, at + 36 * k)[0], head[at + 36 * k + 4 : at + 36 * k + 36]) for k in range(count)]


def _media_rows(batches):
    """Payloads from their chunk lists; raises if a chunk is missing or differs from its digest."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            own, away = unpack.decompress(r["z"]), {c["place"]: c["z"] for c in sorted(r["found"] or (), key=lambda c: c["place"])}
            n_bytes, length, chunks = read_head(r["head"])
            parts, at = [], 0
            for k, (size, digest) in enumerate(chunks):
                if k in away:
                    part = unpack.decompress(away[k])
                else:
                    part, at = own[at : at + size], at + size
                if len(part) != size or hashlib.sha256(part).digest() != digest:
                    raise ValueError(f"chunk {k} of row {r['row']} is not what was stored")
                parts.append(part)
            payload = b"".join(parts)
            if len(payload) != length:
                raise ValueError(f"row {r['row']} is not as long as was stored")
            media = b"".join((r["head"], r["z"], *away.values()))
            x = np.frombuffer(payload, np.uint8)
            share = np.bincount(x >> 4, minlength=16) * 255 // len(x)
            feature = f"chunks={len(parts)};mean={x.mean(dtype=np.float64):.4f};hist={bytes(share.astype(np.uint8)).hex()}"
            out.append((r["row"], n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(parts)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["row", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])


_MEDIA = "row binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def chunked_media(docs: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Stores all payloads in chunks, reads them back and describes them, one row per document.

    docs: doc_id, text; other columns are ignored, whatever their names. Columns: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks. media_bytes and media_sha256 are of
    the stored bytes: head, own packed chunks, and those fetched, in their order; equal texts have equal stored forms. A null text counts as empty and is
    one unit of padding. Rows that repeat give rows that repeat. An empty table gives an empty result.

    The list of documents that lend or borrow chunks is broadcast to the writers only if its estimated size is below
    `broadcast_bytes`; beyond it the documents are dealt out by row instead.
    """
    lists, times, owner, shared, store = stored_chunks(docs, broadcast_bytes)
    held = store.where("row IS NOT NULL")
    chunks = store.where("digest IS NOT NULL").select("digest", "z").join(owner.select("digest", "uses"), "digest")
    found = hot_join(shared.select("row", "place", "digest"), written(chunks, "chunk-lent"), ["digest"], "uses", "inner")  # under a thousand chunks of 16 KB are hot
    fetched = found.groupBy("row").agg(F.collect_list(F.struct("place", "z")).alias("found"))
    none = F.lit(None).cast("array<struct<place:int,z:binary>>")
    columns = ["row", "head", "z", "found"]
    media = held.where("NOT parted").withColumn("found", none).select(*columns).unionByName(held.where("parted").join(fetched, "row").select(*columns))
    media = written(media.mapInArrow(_media_rows, _MEDIA).join(times, "row"), "media")
    # a text that a large share of documents have is one row here, so its documents stay where they are
    return hot_join(lists.select("doc_id", "row"), media, ["row"], "n", "inner").drop("row", "n")


def stored_chunks(docs: DataFrame, broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables of a store: chunk lists (doc_id, row, chunks), texts (row, n: how often), owners of shared chunks (digest,
    own, uses), where those stand (row, place, digest, lends), and the store itself: a row per text (row, parted, head, z) and per lent chunk (digest, z)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.unhex(F.md5("text")))
    base = base.withColumn("key", F.struct("doc_id", "row"))
    lists = base.select("key", "text").mapInArrow(_list_rows, f"key {dict(base.dtypes)['key']}, n_bytes long, chunks array<struct<place:int,size:int,digest:binary>>")
    lists = written(lists.select("key.doc_id", "key.row", "chunks"), "chunk-lists")
    # one row value per distinct text: copies of a whole text share a store row
    refs = lists.groupBy("row").agg(F.first("chunks").alias("chunks")).select("row", F.explode("chunks").alias("c")).select("row", "c.place", "c.digest")
    refs = written(refs, "chunk-refs")
    owner = refs.groupBy("digest").agg(F.min(F.struct("row", "place")).alias("own"), F.count("*").alias("uses")).where("uses > 1")
    owner = written(owner, "chunk-owners")
    shared = written(hot_join(refs, owner, ["digest"], "uses", "inner").select("row", "place", "digest", ((F.col("row") == F.col("own.row")) & (F.col("place") == F.col("own.place"))).alias("lends")), "chunk-shared")
    parted = shared.groupBy("row").agg(F.collect_list(F.when(F.col("lends"), F.col("place"))).alias("lent"), F.collect_list(F.when(~F.col("lends"), F.col("place"))).alias("foreign"))
    parted = written(parted, "chunk-parted")
    small = parted.count() * 64 + shared.count() * 8 <= broadcast_bytes
    firsts = base.select("row", "text")
    times = written(lists.groupBy("row").agg(F.count("*").alias("n")), "chunk-texts")
    copies = written(times.where("n > 1").select("row"), "chunk-copies")
    # texts that stand once are stored where they are; of copies one is taken
    marked = firsts.join(F.broadcast(parted) if small else parted.hint("shuffle_hash"), "row", "left")
    small_copies = copies.count() * 32 <= broadcast_bytes
    marked = marked.join((F.broadcast(copies) if small_copies else copies.hint("shuffle_hash")).withColumn("again", F.lit(True)), "row", "left")
    stored = marked.where("again IS NULL").unionByName(marked.where("again").dropDuplicates(["row"]))
    store = written(stored.select("row", "text", "lent", "foreign").mapInArrow(_store_rows, _STORE), "chunk-store")
    return lists, times, owner, shared, store
