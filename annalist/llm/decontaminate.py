"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased (A-Z) and every run of other ASCII characters
than letters and digits becomes one space.  An item of m bytes may differ from a
passage by e = floor(rate m) edits; cut into e + 1 pieces, at least one piece
stands in the passage unchanged.  One Aho-Corasick automaton finds the pieces of
all items; the window around each hit is verified with Myers' bit-parallel
distance, which is exact.  No passage within the budget is missed.

The items are broadcast in blocks of at most ``BLOCK_BYTES``, each of which reads
the documents once, so the broadcast is bounded whatever the benchmark's size.

Defined results: null and empty texts and items match nothing; an item that
repeats an id is matched by each of its texts, and the nearest counts; a document
is reported once an item, with the smallest distance and, among those, the first
end; rows that repeat are reported alike; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Edits a byte of an item.  At 0.1 pieces have 10 bytes and chance hits cost 2 s a MB; at 0.07 they have 14.
RATE = 0.07
BLOCK_BYTES = 4 << 20

_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_TABLE).split())


def pieces_of(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` pieces of nearly equal length: (offset, piece)."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """Myers' bit vectors of an item."""

    def __init__(self, item: bytes):
        self.size = len(item)
        self.masks: dict[int, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << self.size) - 1, 1 << self.size - 1

    def best(self, text: bytes) -> tuple[int, int]:
        """(smallest edit distance to a substring of ``text``, its first end)."""
        full, top, masks = self.full, self.top, self.masks
        pv, mv, score = full, 0, self.size
        best, end = score, 0
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, j + 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, t) for i, t in items if t]
        self.errors = [int(rate * len(t)) for _, t in self.items]
        self.patterns = [Pattern(t) for _, t in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for offset, piece in pieces_of(t, self.errors[k]):
                places.setdefault(piece.decode("latin-1"), []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, raw: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, budget, end in the normal form), once an item."""
        if not self.items:
            return
        text = normal(raw)
        spans: dict[int, list[list[int]]] = {}
        # pieces that lie next to each other in the same alignment give one window
        for end, (size, where) in self.automaton.iter(text.decode("latin-1")):
            for k, offset in where:
                e = self.errors[k]
                a = max(0, end + 1 - size - offset - e)
                b = min(len(text), end + 1 - size - offset + self.patterns[k].size + e)
                held = spans.setdefault(k, [])
                if held and a <= held[-1][0] + e and a >= held[-1][0] - e:
                    held[-1][0], held[-1][1] = min(a, held[-1][0]), max(b, held[-1][1])
                else:
                    held.append([a, b])
        found: dict[int, tuple[int, int, int]] = {}
        for k, held in spans.items():
            for a, b in held:
                distance, end = self.patterns[k].best(text[a:b])
                if distance <= self.errors[k]:
                    key = self.items[k][0]
                    found[key] = min(found.get(key, (1 << 60, 0, 0)), (distance, a + end, self.errors[k]))
        for key, (distance, end, budget) in found.items():
            yield key, distance, budget, end


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normal(r.text.encode())
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r.item_id, text))
        size += len(text)
    if held:
        yield held


def contamination(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget, end): passages of ``docs`` within ``rate`` edits a byte of an item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, distance long, budget long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):
        out = out.union(rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), rate), schema))
    # an item may stand in two blocks under one id
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end", "budget")).alias("m")).select("doc_id", "item_id", "m.distance", "m.budget", "m.end")


def _scan(held, rate: float):
    def run(batches):
        matcher = Matcher(held.value, rate)
        for batch in tokens.pieces(batches):
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), tokens.as_bytes(batch.column(1)), strict=True) for m in matcher.matches(t)]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "distance", "budget", "end"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with ``is_contaminated``, for filtering; scans each block and keeps all columns, with nothing shuffled.

    The flag replaces a column of its name.
    """
    docs = docs.drop("is_contaminated")
    at = docs.columns.index("text")
    flag = docs.withColumns({"text": F.col("text").cast("string"), "is_contaminated": F.lit(False)})
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("is_contaminated", T.BooleanType())])

    def marker(held):
        def run(batches):
            matcher = Matcher(held.value, rate)
            for batch in tokens.pieces(batches):
                seen = batch.column(batch.num_columns - 1).to_pylist()
                hit = [s or (t is not None and next(matcher.matches(t), None) is not None) for s, t in zip(seen, tokens.as_bytes(batch.column(at)), strict=True)]
                yield pa.record_batch([*batch.columns[:-1], pa.array(hit, pa.bool_())], batch.schema.names)

        return run

    for block in _blocks(items):
        flag = flag.mapInArrow(marker(docs.sparkSession.sparkContext.broadcast(block)), schema)
    return flag
