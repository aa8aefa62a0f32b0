"""Lempel-Ziv phrase fingerprints.

Each text is parsed into dictionary phrases (LZ78 over its UTF-8 bytes: a phrase
is the longest known phrase and one byte more).  The set of phrase hashes is
sketched by the minimum hash in each of ``HASHES`` ranges; the share of equal minima estimates the
Jaccard likeness of the phrase sets, which follows how well one text compresses
given the other.

``with_neighbour`` gives each row the text of the next row in descending id
order without a global window: ids are cut at sampled quantiles into blocks, a
block is sorted in its own task, and the first row of each block is also sent to
the block before it, whose last row needs it.

Defined results: a null text counts as empty; the empty text has the fingerprint
of the empty phrase set and two empty sets are alike (1.0); rows that repeat an id
are ordered by text; null ids come last in descending order; a table of one row is
its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

HASHES = 64
_SHIFT = np.uint64(64 - 6)
_EMPTY = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)


class Parser:
    """LZ78 dictionary.  ``feed`` may be called with consecutive parts of a text."""

    def __init__(self, known: set[str] | None = None, rest: bytes = b""):
        self.known = set() if known is None else known
        self.rest = rest  # the unfinished phrase; it is a known one

    def fork(self) -> Parser:
        """Go on from here apart from this parser."""
        return Parser(set(self.known), self.rest)

    def feed(self, data: bytes) -> np.ndarray:
        """Minima of the hashes of the phrases that ``data`` adds."""
        known, phrase, sizes = self.known, self.rest.decode("latin-1"), []
        add, note = known.add, sizes.append
        for c in data.decode("latin-1"):  # a character a byte
            phrase += c
            if phrase not in known:
                add(phrase)
                note(len(phrase))
                phrase = ""
        data = self.rest + data
        self.rest = phrase.encode("latin-1")
        return _minima(data, np.array(sizes, np.int64))


def _minima(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The smallest hash in each of ``HASHES`` ranges of the phrases that lie end to end in ``data``."""
    if not len(sizes):
        return _EMPTY
    ends = np.cumsum(sizes)
    h = tokens.run_hashes(np.frombuffer(data, np.uint8)[: ends[-1]], ends - sizes, ends)
    out = _EMPTY.copy()
    np.minimum.at(out, (h >> _SHIFT).astype(np.int64), h)
    return out


def signature(minima: np.ndarray) -> np.ndarray:
    """One 32-bit minimum a range; an empty range borrows from the next full one (the distance is hashed in)."""
    full = np.flatnonzero(minima != _EMPTY)
    if not len(full):
        return np.full(HASHES, 0xFFFFFFFF, np.uint32)
    place = np.arange(HASHES)
    donor = full[np.searchsorted(full, place) % len(full)]
    far = ((donor - place) % HASHES).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (tokens.mix(minima[donor] + far * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / HASHES


def text_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_phrases, fingerprint) of every text."""

    def run(batches):
        for batch in tokens.pieces(batches):
            sizes, marks = [], []
            for t in tokens.as_bytes(batch.column(1)):
                parser = Parser()
                marks.append(text_of(signature(parser.feed(t or b""))))
                sizes.append(len(parser.known))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.string())], ["doc_id", "n_phrases", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_phrases long, fingerprint string")


#: Rows of a block, on average, and the most blocks whose limits the driver holds.
BLOCK_ROWS, MOST_BLOCKS = 2000, 100_000


def _blocks(ids: DataFrame) -> list[int]:
    """Lower limits of blocks of ids, ascending; at most ``MOST_BLOCKS``."""
    n = ids.count()
    k = min(MOST_BLOCKS, max(1, n // BLOCK_ROWS))
    if k < 2:
        return []
    return sorted({int(x) for x in ids.where("doc_id is not null").approxQuantile("doc_id", [i / k for i in range(1, k)], 0.2 / k)})


def with_neighbour(docs: DataFrame):
    """(rows sorted by block and descending id, with columns doc_id, text, own, block).

    The first row of each block stands once more (own = false) after the last
    row of the block before it.
    """
    spark = docs.sparkSession
    # nulls are the smallest, so the last in descending order
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    limits = _blocks(rows.select("doc_id"))
    held = spark.sparkContext.broadcast(np.array(limits, np.int64))

    def number(batches):
        import pyarrow.compute as pc

        for batch in batches:
            ids = batch.column(0)
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            out = np.zeros(len(ids), np.int64)
            out[known] = np.searchsorted(held.value, ids.drop_null().to_numpy(zero_copy_only=False), side="right")
            yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "block"])

    # the largest id of each block: a row a block
    heads = rows.select("doc_id").mapInArrow(number, "doc_id long, block long").groupBy("block").agg(F.max("doc_id").alias("head")).orderBy("block").collect()
    places = [h.block for h in heads]
    before = spark.sparkContext.broadcast({(h.block, h.head): places[(i + 1) % len(places)] for i, h in enumerate(heads)})

    def send(batches):
        for batch in number(batches):
            ids, blocks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            also = [(i, before.value[b, x]) for i, (x, b) in enumerate(zip(ids, blocks, strict=True)) if (b, x) in before.value]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([True] * len(ids)), batch.column(2)], ["doc_id", "text", "own", "block"])
            if also:
                part = batch.take(pa.array([i for i, _ in also]))
                yield pa.record_batch([part.column(0), part.column(1), pa.array([False] * len(also)), pa.array([b for _, b in also], pa.int64())], ["doc_id", "text", "own", "block"])

    sent = rows.mapInArrow(send, "doc_id long, text string, own boolean, block long")
    return sent.repartition(F.col("block")).sortWithinPartitions("block", F.desc("own"), F.desc_nulls_last("doc_id"), "text")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document (descending id).

    The edited text keeps the first half of the code points (the larger half)
    and goes on with as many code points of the next text as were dropped.
    """

    def read(doc_id, text):
        n = len(text)
        half = Parser()
        begun = half.feed(text[: n - n // 2].encode())
        whole = half.fork().feed(text[n - n // 2 :].encode())
        return doc_id, text, signature(np.minimum(begun, whole)), half, begun

    def close(row, after):
        doc_id, text, sig, half, begun = row
        n = len(text)
        head = after[1][: n // 2]
        # the parse of the kept half goes on with the other text; minima of a union are the minima of its parts
        edited = signature(np.minimum(begun, half.feed(head.encode())))
        digest = hashlib.sha256((text[: n - n // 2] + head).encode()).hexdigest()
        return doc_id, n, digest, text_of(sig), text_of(edited), likeness(sig, edited), likeness(sig, after[2])

    def run(batches):
        block = waiting = None
        ended = False  # the first row of the next block has been seen
        for batch in tokens.pieces(batches):
            rows = []
            ids, texts, own, blocks = (c.to_pylist() for c in batch.columns)
            for doc_id, text, mine, at in zip(ids, texts, own, blocks, strict=True):
                if at != block:
                    block, waiting, ended = at, None, False
                if ended:
                    continue
                item = read(doc_id, text)
                if waiting is not None:
                    rows.append(close(waiting, item))
                waiting, ended = item, not mine
            yield _pairs_batch(rows)

    return with_neighbour(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
