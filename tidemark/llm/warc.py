"""WARC archives of page captures: records written, read back and assembled into captures.

Each page yields a request record, a response or revisit record and a metadata record, tied together by
WARC-Concurrent-To. Of records with one payload the least page id is the response and the others revisit it. Reading
splits archives into records; the three kinds are joined through their identifiers into one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, hot_join, tasks, written
from tidemark.llm.token_blocks import file_system

DATE = "2024-01-01T00:00:00Z"
LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 32 << 20


def record_id(page: int | str, digest: str, kind: str) -> str:
    """A name-based URN of a page and its payload, the same at every attempt; a page without an id goes by its address."""
    h = hashlib.sha256(f"{kind}:{page}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def capture_records(page: int | None, url: str | None, html: bytes, digest: str, first: int | None) -> list[bytes]:
    """request, response or revisit, and metadata records of one page; `first` is the page whose payload it is."""
    uri = re.sub(r"[\x00-\x20\x7f]+", "%20", url or "urn:page:none")
    name = uri if page is None else page
    own = record_id(name, digest, "response")
    told = "" if page is None else f"page-id: {page}\r\n"
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    asked = b"GET / HTTP/1.1\r\n\r\n"
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{told and 'X-' + told.title()}Content-Length: {len(html)}\r\n\r\n".encode()
    main = [*common, ("WARC-Record-ID", own), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first == page:
        body = record("response", main, answer + html)
    else:
        body = record("revisit", [*main, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest, "response")), ("WARC-Refers-To-Page", str(first))], answer)
    return [
        record("request", [*common, ("WARC-Record-ID", record_id(name, digest, "request")), ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], asked),
        body,
        record("metadata", [*common, ("WARC-Record-ID", record_id(name, digest, "metadata")), ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], f"{told}payload-bytes: {len(html)}\r\nhas-url: {int(url is not None)}\r\n".encode()),
    ]


def _write_archives(folder: str):
    """Archives named by attempt, and a row for each; only those that the written manifest lists are read."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = file_system(folder)
        made: list[str] = []
        out, size = None, 0
        for batch in batches:
            for page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    made.append(f"{base}/part-{task.partitionId():06d}-{len(made):06d}-{task.taskAttemptId()}.warc.gz")
                    out, size = store.open_output_stream(made[-1], compression=None), 0
                for r in capture_records(page, url, (html or "").encode("utf-8", "replace"), digest, first):
                    member = gzip.compress(r, 6, mtime=0)
                    out.write(member)
                    size += len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()] * len(made), pa.int64()), pa.array(made)], ["task", "path"])

    return run


def members(stream, step: int = 1 << 14) -> Iterator[bytes]:
    """What each gzip member of an archive holds; the archive is read in small steps."""
    fed = stream.read(step)
    while fed:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not fed:
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(fed))
            fed = z.unused_data if z.eof else stream.read(step)
        yield b"".join(parts)
        fed = fed or stream.read(step)


def split_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an open archive, gzipped member by member or plain."""
    start = stream.read(2)
    stream.seek(0)
    for data in members(stream) if start == b"\x1f\x8b" else [stream.read()]:
        at = 0
        while at < len(data):
            if data[at : at + 5] != b"WARC/":
                raise ValueError("not a WARC record")
            end = data.index(b"\r\n\r\n", at)
            fields: dict[str, str] = {}
            for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                fields.setdefault(k.strip().lower(), v.strip())
            size = int(fields["content-length"])
            yield fields, data[end + 4 : end + 4 + size]
            at = end + 4 + size
            while data[at : at + 2] == b"\r\n":
                at += 2


_RECORDS = "kind string, id string, to string, uri string, digest string, refers string, refers_page long, page long, payload_bytes long, payload_sha256 string, has_url boolean"
_NAMES = [x.split()[0] for x in _RECORDS.split(", ")]
_TYPES = [pa.string()] * 6 + [pa.int64()] * 3 + [pa.string(), pa.bool_()]


def _read_archives(folder: str):
    def run(batches):
        store, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[tuple] = []
                with store.open_input_file(path) as f:
                    for row in map(_record_row, split_records(f)):
                        out.append(row)
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

    return run


def _record_row(found: tuple[dict[str, str], bytes]) -> tuple:
    f, block = found
    kind = f["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else b""
    own = re.search(rb"(?i)x-page-id: (-?\d+)|page-id: (-?\d+)", block.partition(b"\r\n\r\n")[0]) if kind != "request" else None
    size = re.search(rb"payload-bytes: (\d+)", block) if kind == "metadata" else None
    return (
        kind, f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, f.get("warc-refers-to"),
        int(f["warc-refers-to-page"]) if "warc-refers-to-page" in f else None, int(own[1] or own[2]) if own else None,
        int(size[1]) if size else len(payload), hashlib.sha256(payload).hexdigest() if kind == "response" else None, b"has-url: 1" in block if kind == "metadata" else None,
    )


def write_warc(pages: DataFrame) -> tuple[str, DataFrame]:
    """Archives of all pages in a new folder of the shared directory: its address, and the manifest (task, path).

    pages: page_id, url, html. A null html is an empty payload. Payloads of less than 100 bytes are always responses.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    store, base = file_system(folder)
    store.create_dir(base)
    rows = pages.select("page_id", "url", "html", F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    first = rows.where(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = hot_join(rows, written(first, "payloads"), ["digest"], "n", "left")  # equal digests, equal sizes
    shared = shared.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "digest", F.when(F.col("page_id").isNotNull(), F.coalesce("first", "page_id")).cast("long").alias("first"))
    return folder, written(shared.mapInArrow(_write_archives(folder), "task long, path string"), "warc-manifest")


def read_captures(folder: str, manifest: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, url, response, request, metadata, joined through WARC-Concurrent-To.

    manifest: path, a row per archive (any file system that pyarrow knows; `folder` names it). A response or revisit
    without request or metadata keeps nulls there; those without a response are left out.
    """
    files = manifest.select("path").repartition(max(tasks(manifest), manifest.count()))
    records = written(files.mapInArrow(_read_archives(folder), _RECORDS), "warc-records")
    main = records.where("kind IN ('response', 'revisit')")
    asked = records.where("kind = 'request'").groupBy("to").agg(F.min(F.struct("id", "uri")).alias("request"))
    told = records.where("kind = 'metadata'").groupBy("to").agg(F.min(F.struct("id", "page", "payload_bytes", "has_url")).alias("metadata"))
    joined = main.join(asked.withColumnRenamed("to", "a"), F.col("id") == F.col("a"), "left").join(told.withColumnRenamed("to", "b"), F.col("id") == F.col("b"), "left")
    return joined.select(
        F.col("page").alias("page_id"), F.when(F.col("metadata.has_url"), F.col("uri")).alias("url"),
        F.struct("id", "kind", "digest", "payload_bytes", "payload_sha256", "refers", F.col("refers_page").alias("refers_to")).alias("response"), "request", "metadata",
    )


def captures(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC archives, reads them back and assembles captures.

    pages: page_id (a whole number), url, html; other columns are ignored, whatever their names. A row without a
    page_id is always a response, with an identifier of its address and payload. Rows that repeat a page_id and payload give one record each with the
    same identifier, and one capture row each; with another payload they have an identifier of their own. An empty table gives an empty result.
    """
    return read_captures(*write_warc(pages))


def capture_digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture, from the archives.

    A revisit's payload is that of the response it refers to; its length and digest are taken there.
    """
    rows = captures(pages).select("page_id", "response", F.coalesce("response.refers", "response.id").alias("rid"))
    rows = written(rows, "capture-rows")
    main = F.when(F.col("response.kind") == "response", F.struct(F.col("response.payload_bytes").alias("n"), F.col("response.payload_sha256").alias("d")))
    kept = written(rows.groupBy("rid").agg(F.min(main).alias("p"), F.count("*").alias("uses")), "capture-payloads")
    joined = hot_join(rows, kept, ["rid"], "uses", "inner")  # one payload may be a large share of all pages
    return joined.select("page_id", F.col("p.n").alias("payload_bytes"), F.col("p.d").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("refers_to"))
