"""Substring dedup with suffix automata of the reference passages.

``matched_spans`` treats the corpus as its own reference: a window of
``min_words`` words is a repeat if the same words also start in a document with
a smaller id.

1. *Anchors.*  Of the ``k``-word hashes inside each window the smallest is the
   window's anchor, so equal windows have equal anchors and a document has about
   ``2 / (min_words - k + 2)`` anchors a word.  Anchors of a single document are
   dropped (``shared_keys``: packed, pre-aggregated).
2. *Passages.*  Runs of windows whose anchor is shared are cut out.  Their window
   hashes route each passage to the first passage that has the window
   (``first_holders``: packed and pre-aggregated likewise).
3. *Automata.*  Passages meet their reference passages in an equi-join.  Each
   task builds the suffix automaton of a reference passage once, streams the
   document passages through it for matching statistics, and returns the spans
   of at least ``min_words`` words.  Only words compared by an automaton are
   ever removed; hashes merely choose which automaton to ask.

The whole corpus is no bounded reference, so its automata are routed by joins
and not broadcast.  ``strip_reference`` is the form with broadcast automata, for
a reference of a checked size.

Defined results: a null or empty text has no words and keeps nothing; documents
with a null id are never a reference and lose nothing; rows that repeat an id
are judged one by one, and equal ids never match each other; texts shorter than
the window stay whole; other columns are passed through untouched.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared_keys import bucket_count, first_holders, fold, shared_keys
from .storage import only_near, stored

#: Words of an anchor at least; longer windows have anchors of a third of their words, which few texts share by chance.
ANCHOR_WORDS = 4


class SuffixAutomaton:
    """Suffix automaton over the words of one or more passages."""

    def __init__(self, passages: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for words in passages:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:  # the word already follows: passages share a prefix
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal runs of ``words`` covered by matches of at least ``least`` words, as half-open intervals."""
        nxt, link, length = self.next, self.link, self.length
        out: list[list[int]] = []
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            else:
                matched = 0
            if matched >= least:
                a, b = i + 1 - matched, i + 1
                if out and a <= out[-1][1]:
                    out[-1][0] = min(out[-1][0], a)
                    out[-1][1] = b
                else:
                    out.append([a, b])
        return [(a, b) for a, b in out]


def _minima(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    have = 1
    while have < w:
        step = min(have, w - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    return g


def _windows(buf: tokens.Buffer, width: int, k: int):
    """(word hashes, anchor of each window, is the window inside one text, index of its text)."""
    h = buf.hashes()
    if len(h) < width:
        return h, h[:0], np.zeros(0, bool), np.zeros(0, np.int64)
    anchor = _minima(tokens.grams(h, k), width - k + 1)
    text = np.repeat(np.arange(len(buf.first) - 1), np.diff(buf.first))
    return h, anchor, text[: len(anchor)] == text[width - 1 :], text[: len(anchor)]


def _anchors(width: int, k: int):
    """Ids and anchors of documents, as ``shared_keys`` takes them."""

    def emit(batches):
        for batch in tokens.pieces(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, held in tokens.slices(tokens.as_bytes(batch.column(1))):
                _, anchor, inside, text = _windows(tokens.Buffer(held), width, k)
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                new &= inside
                yield ids[at + text[new]], anchor[new]

    return emit


def _passages(width: int, k: int, buckets: int):
    def run(batches):
        for batch in tokens.pieces(batches):
            ids, ths, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            rows: dict[str, list] = {"doc_id": [], "th": [], "part": [], "words": []}
            for at, held in tokens.slices(tokens.as_bytes(batch.column(2))):
                buf = tokens.Buffer(held)
                anchor = tokens.signed(fold(_windows(buf, width, k)[1], buckets))
                for i in range(len(held)):
                    a, b = buf.first[i], buf.first[i + 1] - width + 1
                    if b <= a:
                        continue
                    near = np.isin(anchor[a:b], np.asarray(keys[at + i], np.int64))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]])))
                    for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                        rows["doc_id"].append(ids[at + i])
                        rows["th"].append(ths[at + i])
                        rows["part"].append(s)
                        rows["words"].append(b" ".join(buf.words(a + s, a + e + width - 1)))
            yield pa.record_batch([*(pa.array(rows[c], pa.int64()) for c in ("doc_id", "th", "part")), pa.array(rows["words"], pa.binary())], list(rows))

    return run


def _places(width: int):
    """Places and hashes of the windows of passages, as ``first_holders`` takes them."""

    def emit(batches):
        for batch in tokens.pieces(batches, "words"):
            ids, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, held in tokens.slices(batch.column(2).to_pylist()):
                buf = tokens.Buffer(held)
                full = tokens.grams(buf.hashes(), width)
                text = np.repeat(np.arange(len(held)), np.diff(buf.first))
                inside = text[: len(full)] == text[width - 1 :]
                row = at + text[: len(full)][inside]
                yield ids[row], parts[row], full[inside]

    return emit


#: Words of reference passages whose automata a task keeps.
CACHE_WORDS = 60_000


def _ask(width: int):
    def run(batches):
        cache: OrderedDict[tuple[int, int, int], SuffixAutomaton] = OrderedDict()
        held = 0
        for batch in batches:
            out = {"doc_id": [], "th": [], "start": [], "end": []}
            ids, ths, parts, ref_ids, ref_ths, ref_parts = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
            for i, key in enumerate(zip(ref_ids, ref_ths, ref_parts, strict=True)):
                if key not in cache:
                    ref = batch.column(7)[i].as_py().split(b" ")
                    cache[key] = SuffixAutomaton([ref])
                    held += len(cache[key].next)
                    while held > CACHE_WORDS and len(cache) > 1:
                        held -= len(cache.popitem(last=False)[1].next)
                for a, b in cache[key].spans(batch.column(3)[i].as_py().split(b" "), width):
                    out["doc_id"].append(ids[i])
                    out["th"].append(ths[i])
                    out["start"].append(a + parts[i])
                    out["end"].append(b + parts[i])
            yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text); ``th`` tells rows of one id apart by their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("th"), F.col("text").cast("string").alias("text"))


def matched_spans(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """(doc_id, th, spans array<struct<start,end>>): half-open word intervals of documents' repeats of earlier documents."""
    if min_words < 1:
        raise ValueError("min_words must be positive")
    k = min(max(ANCHOR_WORDS, min_words // 3), min_words)
    rows = _keyed(docs).where("doc_id is not null and text is not null")
    buckets = bucket_count(docs)
    mine = stored(shared_keys(rows.select("doc_id", "text"), _anchors(min_words, k), buckets), "anchors")
    # the join leaves rows of one id together, so rows that repeat id and text go without a shuffle
    near = only_near(rows, mine).join(mine.hint("shuffle_hash"), "doc_id").select("doc_id", "th", "text", "keys").dropDuplicates(["doc_id", "th"])
    words = stored(near.mapInArrow(_passages(min_words, k, buckets), "doc_id long, th long, part long, words binary"), "passages")

    # texts that share an id share its places: more automata are asked, none less
    pairs = stored(first_holders(words.select("doc_id", "part", "words"), _places(min_words), buckets), "pairs")
    refs = words.select(F.col("doc_id").alias("ref_id"), F.col("th").alias("ref_th"), F.col("part").alias("ref_part"), F.col("words").alias("ref_words"))
    asked = pairs.join(words, ["doc_id", "part"]).join(refs, ["ref_id", "ref_part"]).select("doc_id", "th", "part", "words", "ref_id", "ref_th", "ref_part", "ref_words")
    spans = asked.mapInArrow(_ask(min_words), "doc_id long, th long, start long, end long").distinct()
    return spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _kept(buf: tokens.Buffer, i: int, spans) -> tuple[int, int, bytes]:
    """(words, words removed, the other words joined by a space) of a buffer's text."""
    a, b = int(buf.first[i]), int(buf.first[i + 1])
    keep = np.ones(b - a, bool)
    for s in spans or ():
        keep[s["start"] : s["end"]] = False
    left = np.flatnonzero(keep) + a
    return b - a, b - a - len(left), b" ".join(buf.raw[s:e] for s, e in zip(buf.start[left].tolist(), buf.end[left].tolist(), strict=True))


def substring_dedup(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """The rows of ``docs`` with repeats cut out: texts that lose words become their kept words joined by one space,
    other texts stay as they are.  Adds n_words, n_removed and spans; ``n_chars``, where present, follows the text.
    Added columns replace those of their names.
    """
    docs = docs.drop("n_words", "n_removed", "spans")
    spans = stored(matched_spans(docs, min_words), "spans")
    # the columns travel in one, so that no name can clash
    packed = docs.select(F.struct(*docs.columns).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("th"))
    joined = packed.join(spans.hint("shuffle_hash"), ["doc_id", "th"], "left").select("kept.*", "spans")
    at = docs.columns.index("text")

    def run(batches):
        for batch in tokens.pieces(batches):
            texts, marks = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            n_words, n_removed = [], []
            for i, held in tokens.slices(tokens.as_bytes(batch.column(at))):
                buf = tokens.Buffer(held)
                for j in range(len(held)):
                    n, gone, left = _kept(buf, j, marks[i + j])
                    n_words.append(n)
                    n_removed.append(gone)
                    if gone:
                        texts[i + j] = left.decode()
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.record_batch([*arrays[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), arrays[-1]], [*batch.schema.names[:-1], "n_words", "n_removed", "spans"])

    from pyspark.sql import types as T

    schema = T.StructType([*[T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType, True) for f in docs.schema], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", joined.schema["spans"].dataType)])
    out = joined.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def _digest(with_spans: bool):
    def run(batches):
        for batch in tokens.pieces(batches):
            out = {"n_words": [], "n_removed": [], "kept_sha256": []}
            marks = batch.column(3).to_pylist() if with_spans else [None] * batch.num_rows
            for i, held in tokens.slices(tokens.as_bytes(batch.column(2))):
                buf = tokens.Buffer(held)
                for j in range(len(held)):
                    n, gone, left = _kept(buf, j, marks[i + j])
                    out["n_words"].append(n)
                    out["n_removed"].append(gone)
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())], ["doc_id", "th", *out])

    return run


def dedup_digest(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``substring_dedup``; only texts that may lose words are shuffled."""
    schema = "doc_id long, th long, n_words long, n_removed long, kept_sha256 string"
    rows = _keyed(docs)
    spans = stored(matched_spans(docs, min_words), "spans")
    cut = only_near(rows.where("doc_id is not null"), spans).join(spans.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "th", "text", "spans").mapInArrow(_digest(True), schema).dropDuplicates(["doc_id", "th"])
    whole = rows.mapInArrow(_digest(False), schema)
    cut = cut.select("doc_id", "th", F.col("n_removed").alias("cut"), F.col("kept_sha256").alias("cut_sha256"))
    return whole.join(cut, ["doc_id", "th"], "left").select("doc_id", "n_words", F.coalesce("cut", "n_removed").alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"))


#: Bytes of a reference that ``strip_reference`` broadcasts, and of one shard of it.
REFERENCE_BYTES, SHARD_BYTES = 8 << 20, 1 << 20


def strip_reference(docs: DataFrame, reference: DataFrame, min_words: int = 13, most: int = REFERENCE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) after removing what also stands in ``reference`` (column text).

    The reference is cut into shards whose suffix automata are broadcast; a
    reference of more than ``most`` bytes is refused, as it must fit each worker:
    union it with the documents and use ``substring_dedup`` instead.
    """
    spark = docs.sparkSession
    size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most:
        raise ValueError(f"the reference has {size} bytes, the limit is {most}")
    shards: list[list[bytes]] = [[]]
    for r in reference.select("text").where("text is not null").toLocalIterator():
        if sum(map(len, shards[-1])) > SHARD_BYTES:
            shards.append([])
        shards[-1].append(r.text.encode())
    held = spark.sparkContext.broadcast(shards)

    def run(batches):
        automata = []
        for shard in held.value:
            buf = tokens.Buffer(shard)
            automata.append(SuffixAutomaton([buf.words(buf.first[i], buf.first[i + 1]) for i in range(len(shard))]))
        for batch in tokens.pieces(batches):
            rows = []
            for _, texts in tokens.slices(tokens.as_bytes(batch.column(1))):
                buf = tokens.Buffer(texts)
                for i in range(len(texts)):
                    words = buf.words(buf.first[i], buf.first[i + 1])
                    rows.append(_kept(buf, i, [{"start": a, "end": b} for x in automata for a, b in x.spans(words, min_words)]))
            yield pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
