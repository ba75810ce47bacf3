"""Token-id files of patched frame-of-reference blocks.

A file holds whole documents in ascending doc_id order. Ids come in blocks of 256: the block's minimum is
subtracted and what remains is packed at the bit width of a percentile of it, the percentile with the smallest
block; larger values keep their low bits in place and their high bits in the block's exception list.

File, little-endian: b"PFR1", blocks, block starts (u64 each), documents (i64 id, u8 id present, u64 ids each),
then u64 number of ids, u64 documents, u64 blocks. Block: u32 minimum, u16 ids, u16 exceptions, u8 width, packed
bits, exception places (u8 each), exception high bits (u32 each).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, slices, tasks, written
from tidemark.llm.tokens import encoder

BLOCK = 256
HEAD, HEAD_SIZE = "<IHHB", 9
FOOT, FOOT_SIZE = "<QQQ", 24
MAGIC = b"PFR1"
PERCENTILES = (75, 90, 95, 98, 99, 100)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each number below 2 ** 32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each number end to end, a row of bytes for each row."""
    size = 2 if w <= 16 else 4
    raw = v.astype(f"<u{size}").view(np.uint8)
    if w == 8 * size:
        return raw
    bits = np.unpackbits(raw.reshape(*v.shape, size), axis=2, bitorder="little")[:, :, :w]
    return np.packbits(bits.reshape(len(v), -1), axis=1, bitorder="little")


def _unpack(raw: np.ndarray, n: int, w: int) -> np.ndarray:
    """n numbers of w bits from each row of bytes."""
    size = 2 if w <= 16 else 4
    if w < 8 * size:
        bits = np.zeros((len(raw), n, 8 * size), np.uint8)
        bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little", count=n * w).reshape(len(raw), n, w)
        raw = np.packbits(bits.reshape(len(raw), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{size}").astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of 256 ids, the last one shorter."""
    whole = len(ids) // BLOCK
    parts = [ids[: whole * BLOCK].reshape(whole, BLOCK)] if whole else []
    if len(ids) % BLOCK:
        parts.append(ids[whole * BLOCK :].reshape(1, -1))
    out: list[bytes] = []
    for part in parts:
        low = part.min(1)
        rest = part - low[:, None]
        n = part.shape[1]
        ranked = np.sort(rest, 1)
        places = np.ceil(np.array(PERCENTILES) / 100 * n).astype(int) - 1
        widths = _bits(ranked[:, places])
        past = (1 << widths.clip(max=32)) - 1
        cost = np.stack([n * w + 40 * (ranked[:, PERCENTILES[0] * n // 100 :] > m[:, None].astype(np.uint32)).sum(1) for w, m in zip(widths.T, past.T)], 1)
        width = widths[np.arange(len(part)), cost.argmin(1)]
        blocks: list = [b""] * len(part)
        for w in np.unique(width):
            on = np.flatnonzero(width == w)
            v = rest[on]
            packed = _pack(v, int(w))
            high = v >> np.uint32(w) if w < 32 else np.zeros_like(v)
            for k, b in enumerate(on):
                exc = np.flatnonzero(high[k])
                blocks[b] = struct.pack(HEAD, int(low[b]), n, len(exc), int(w)) + packed[k].tobytes() + exc.astype(np.uint8).tobytes() + high[k][exc].astype("<u4").tobytes()
        out += blocks
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that start at `starts`."""
    heads = [struct.unpack_from(HEAD, data, s) for s in starts.tolist()]
    out = np.zeros(sum(h[1] for h in heads), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    groups: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    at = 0
    for (low, n, exc, w), s in zip(heads, starts.tolist()):
        groups.setdefault((n, w), []).append((at, s + HEAD_SIZE, low, exc))
        at += n
    for (n, w), blocks in groups.items():
        size = (n * w + 7) // 8
        place, body, low, exc = (np.array(c, np.int64) for c in zip(*blocks))
        if w:
            v = _unpack(raw[body[:, None] + np.arange(size)], n, w)
        else:
            v = np.zeros((len(blocks), n), np.uint32)
        for k in np.flatnonzero(exc):
            p = body[k] + size
            e = int(exc[k])
            v[k, raw[p : p + e]] |= np.frombuffer(data, "<u4", e, p + e) << np.uint32(w)
        out[place[:, None] + np.arange(n)] = v + low[:, None].astype(np.uint32)
    return out


def file_system(uri: str):
    """A file system and the path in it, for any address pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _File:
    """A token file in the making. Its name holds the attempt, and only files that the manifest lists are ever read."""

    def __init__(self, store, path: str):
        self.out, self.path, self.at = store.open_output_stream(path), path, len(MAGIC)
        self.out.write(MAGIC)
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.held, self.ids = np.zeros(0, np.uint32), 0

    def add(self, docs: list[tuple[int, int, int]], ids: bytes, last: bool = False) -> None:
        self.docs += docs
        self.held = np.concatenate((self.held, np.frombuffer(ids, "<u4")))
        ready = len(self.held) if last else len(self.held) // BLOCK * BLOCK
        for block in encode_blocks(self.held[:ready]):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.ids, self.held = self.ids + ready, self.held[ready:]

    def close(self) -> tuple[str, int, int]:
        self.add([], b"", last=True)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        i, has, n = (np.array(c) for c in zip(*self.docs))
        self.out.write(i.astype("<i8").tobytes() + has.astype(np.uint8).tobytes() + n.astype("<u8").tobytes())
        self.out.write(struct.pack(FOOT, self.ids, len(self.docs), len(self.starts)))
        self.out.close()
        return self.path, self.ids, len(self.docs)


def _write_files(folder: str, tokenizer: str, end: int, file_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        code = encoder(tokenizer, 1_000_000)
        store, base = file_system(folder)
        made: list[tuple[str, int, int]] = []
        out = None
        for batch in slices(batches, "text"):
            coded = code.encode(batch.column(1).to_pylist(), end)
            if out is None:
                out = _File(store, f"{base}/shard-{task.partitionId():06d}-{len(made):06d}-{task.taskAttemptId()}.pfr")
            out.add([(i or 0, int(i is not None), len(c) // 4) for i, c in zip(batch.column(0).to_pylist(), coded)], b"".join(coded))
            if out.at >= file_bytes:
                made.append(out.close())
                out = None
        if out is not None:
            made.append(out.close())
        if made:
            path, ids, docs = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()] * len(made), pa.int64()), pa.array(range(len(made)), pa.int64()), pa.array(path), pa.array(ids, pa.int64()), pa.array(docs, pa.int64())], ["shard", "part", "path", "n_ids", "n_docs"])

    return run


def _read_files(folder: str):
    """Reads a million ids at a time through the index of block starts, whatever the file's size."""

    def run(batches):
        store, _ = file_system(folder)
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(path) as f:
                    size = f.size()

                    def part(at: int, n: int) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    n_ids, n_docs, n_blocks = struct.unpack(FOOT, part(size - FOOT_SIZE, FOOT_SIZE))
                    at = size - FOOT_SIZE - 17 * n_docs
                    table = part(at, 17 * n_docs)
                    ids, has, n = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, np.uint8, n_docs, 8 * n_docs), np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
                    starts = np.append(np.frombuffer(part(at - 8 * n_blocks, 8 * n_blocks), "<u8").astype(np.int64), at - 8 * n_blocks)
                    past, doc, crc = np.cumsum(n), 0, 0
                    sums, left = [], int(n[0])
                    for b in range(0, n_blocks, 4096):
                        e = min(n_blocks, b + 4096)
                        need = decode_blocks(part(int(starts[b]), int(starts[e] - starts[b])), starts[b:e] - starts[b]).astype("<u4", copy=False)
                        k = 0
                        while doc < n_docs and k < len(need):  # a document may go on in the next part
                            take = min(left, len(need) - k)
                            crc, k, left = zlib.crc32(need[k : k + take], crc), k + take, left - take
                            if not left:
                                sums.append(crc)
                                doc, crc = doc + 1, 0
                                left = int(n[doc]) if doc < n_docs else 0
                if len(sums) != n_docs or int(past[-1]) != n_ids:
                    raise ValueError(f"token file {path} does not add up")
                for k in range(0, n_docs, 10_000):
                    to = slice(k, k + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[to], mask=has[to] == 0), pa.array(base + (past - n)[to]), pa.array(n[to]), pa.array(sums[to], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end: int = 2, file_bytes: int = 128 << 20) -> tuple[str, DataFrame]:
    """Files in a new folder of the shared directory, in ascending doc_id order, and their manifest: shard, part, path,
    n_ids, n_docs, a row per file. A task begins another file once one has `file_bytes` (and ends the document)."""
    folder = fresh_path(docs.sparkSession, "token-files")
    store, base = file_system(folder)
    store.create_dir(base)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))  # many rows of one id need not be one task's
    dealt = dealt.repartitionByRange(tasks(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return folder, written(dealt.mapInArrow(_write_files(folder, tokenizer, end, file_bytes), "shard long, part long, path string, n_ids long, n_docs long"), "token-manifest")


def token_documents(docs: DataFrame, tokenizer: str, end: int = 2, file_bytes: int = 128 << 20) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32 per document.

    docs: doc_id (a whole number), text; other columns are ignored, whatever their names. A null or empty text is the
    end id alone. Null ids come first; rows with equal ids come next to each other in any order. An empty table
    gives no files and an empty result. Only files that the committed manifest lists are read, so tasks that ran twice
    leave nothing behind that counts.
    """
    folder, manifest = write_token_files(docs, tokenizer, end, file_bytes)
    before = F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")).repartition(max(tasks(docs), manifest.count()))
    return files.mapInArrow(_read_files(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
