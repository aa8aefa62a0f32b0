"""WARC archives as a chunked record table.

Writing: every page becomes a record.  A payload longer than ``chunk_bytes`` is
written as a first segment and continuation segments (the format's segmented
records), so neither side ever holds a whole large record.  Payloads of at least
``least`` bytes that repeat an earlier page's become ``revisit`` records; the
digest join is pre-aggregated, and a digest shared by very many pages is split
by AQE.  Files are written and read by Spark's own text source (gzip, so each
file is one ordered stream); the row separator CR LF CR LF is the blank line that
the format has after each header block and record anyway, so the files are plain
WARC/1.1.

Reading: ``read_chunks`` streams the archives into rows (record id, chunk number,
bytes), each carrying the running byte count and SHA-256 of its record up to and
including the chunk; the last row of a record has the full digest.  Reassembly is
by Content-Length, so payloads may hold the separator.

Defined results: a null html is an empty payload; empty and short payloads are
always responses; pages that repeat the smallest page_id of a payload are
responses too; a null page_id is written as ``null`` and read back as null, and
is never the page that others refer to; an empty table writes no record.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
GAP = "\r\n\r\n"
#: Payload bytes of a segment.
CHUNK_BYTES = 1 << 20
#: Smaller payloads are never revisits.
REVISIT_BYTES = 100

CHUNKS = "page_id long, chunk int, bytes_so_far long, digest_so_far string, last boolean, record_type string, refers_to long, payload_bytes long, payload_digest string, url string"


def _typed(pages: DataFrame, least: int) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "digest", "left")
    again = (F.col("n") >= least) & (F.col("first") < F.col("page_id"))
    return rows.withColumn("refers_to", F.when(again, F.col("first")))


def _segments(chunk_bytes: int):
    """Records of a page: rows of one column, in order."""

    def run(batches):
        for batch in batches:
            out: list[str] = []
            held = 0
            page, url, html, n, digest, refers = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                pid = page[i].as_py()
                name = f"<urn:page:{'null' if pid is None else pid}>"
                head = [f"WARC-Record-ID: {name}", f"WARC-Target-URI: {url[i].as_py()}", f"WARC-Payload-Digest: sha256:{digest[i].as_py()}", f"WARC-Payload-Length: {n[i].as_py()}"]
                if refers[i].is_valid:
                    out.append(CRLF.join(["WARC/1.1", "WARC-Type: revisit", *head, f"WARC-Refers-To: <urn:page:{refers[i].as_py()}>", "Content-Length: 0"]) + GAP)
                    continue
                body = html[i].as_py()
                cuts = list(_cuts(body, chunk_bytes))
                for k, (part, size) in enumerate(cuts):
                    lines = ["WARC/1.1", "WARC-Type: " + ("response" if not k else "continuation"), *(head if not k else [f"WARC-Record-ID: {name[:-1]}:{k}>", f"WARC-Segment-Origin-ID: {name}"])]
                    if len(cuts) > 1:
                        lines.append(f"WARC-Segment-Number: {k + 1}")
                        if k == len(cuts) - 1:
                            lines.append(f"WARC-Segment-Total-Length: {n[i].as_py()}")
                    out.append(CRLF.join([*lines, f"Content-Length: {size}"]) + GAP + part)
                    held += size
                    if held > 4 << 20:
                        yield pa.record_batch({"value": pa.array(out, pa.string())})
                        out, held = [], 0
            yield pa.record_batch({"value": pa.array(out, pa.string())})

    return run


def _cuts(body: str, chunk_bytes: int):
    """(part, its bytes): parts of at most ``chunk_bytes`` UTF-8 bytes, cut between code points; one at least."""
    step = max(1, chunk_bytes // 4)
    if len(body) <= step or len(body) <= chunk_bytes and body.isascii():
        yield body, len(body) if body.isascii() else len(body.encode())
        return
    for i in range(0, len(body), step):
        part = body[i : i + step]
        yield part, len(part.encode())


def write_warc(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, least: int = REVISIT_BYTES) -> None:
    """Write one record for each row of ``pages`` (page_id, url, html) to WARC files below ``path``."""
    rows = _typed(pages, least).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "n", "digest", "refers_to")
    rows.mapInArrow(_segments(chunk_bytes), "value string").write.option("lineSep", GAP).option("compression", "gzip").text(path)


class _Stream:
    """The bytes of one archive, given piece by piece; parses records without holding a whole one."""

    def __init__(self):
        self.buffer = bytearray()
        self.left = -1  # bytes of the current block still to come; -1: in a header block
        self.head: dict[str, str] = {}
        self.record: dict | None = None

    def feed(self, piece: bytes):
        self.buffer += piece
        while True:
            if self.left < 0:
                at = self.buffer.find(b"\r\n\r\n")
                if at < 0:
                    return
                lines = bytes(self.buffer[:at]).decode().split(CRLF)
                del self.buffer[: at + 4]
                if lines == [""] or not lines:
                    continue
                self.head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                self.left = int(self.head["Content-Length"])
                self.parts = 0
                if self.head["WARC-Type"] != "continuation":
                    self.record = {"chunk": 0, "bytes": 0, "sha": hashlib.sha256(), "total": int(self.head["WARC-Payload-Length"]), "head": self.head}
            take = min(self.left, len(self.buffer))
            if take < self.left and take < 65536:
                return  # wait for more
            data = bytes(self.buffer[:take])
            del self.buffer[:take]
            self.left -= take
            if self.left == 0:
                if len(self.buffer) < 4:
                    self.buffer[:0] = data
                    self.left = take
                    return  # the blank line after the block comes first
                del self.buffer[:4]
                self.left = -1
            yield self._row(data)

    def _row(self, data: bytes) -> tuple:
        r = self.record
        r["sha"].update(data)
        r["bytes"] += len(data)
        head = r["head"]
        kind = head["WARC-Type"]
        number = lambda x: None if x == "null" else int(x)
        row = (number(head["WARC-Record-ID"][10:-1]), r["chunk"], r["bytes"], r["sha"].hexdigest(), r["bytes"] == (r["total"] if kind == "response" else 0), kind, number(head["WARC-Refers-To"][10:-1]) if kind == "revisit" else None, r["total"], head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Target-URI"], data)
        r["chunk"] += 1
        return row


def read_chunks(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    """(page_id, chunk, bytes, running count and digest, record headers) of all archives below ``path``.

    ``with_bytes=False`` leaves the payload out after it has been digested.
    """
    lines = spark.read.option("lineSep", GAP).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    names = [x.strip().split(" ")[0] for x in CHUNKS.split(",")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if with_bytes:
        names, kinds = [*names, "bytes"], [*kinds, pa.binary()]

    def run(batches):
        stream, file = _Stream(), None
        for batch in batches:
            rows, held = [], 0
            values = batch.column(0).cast(pa.binary())
            files = batch.column(1)
            for i in range(batch.num_rows):
                at = files[i].as_py()
                if at != file:
                    stream, file = _Stream(), at
                for row in stream.feed(values[i].as_py() + b"\r\n\r\n"):
                    rows.append(row)
                    held += len(row[-1]) if with_bytes else 0
                    if held > 4 << 20:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
            yield _batch(rows, names, kinds)

    return lines.mapInArrow(run, CHUNKS + (", bytes binary" if with_bytes else ""))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def records(chunks: DataFrame) -> DataFrame:
    """One row for each record: the last chunk's running digest is the payload's; a revisit has its header's."""
    own = F.col("record_type") == "response"
    return chunks.where("last").select("page_id", "payload_bytes", F.when(own, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to", F.when(own, F.col("digest_so_far") == F.col("payload_digest")).otherwise(True).alias("verified"))
