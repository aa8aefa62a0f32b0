"""Which 64-bit keys occur in more than one document, and in which documents.

Both steps move packed blobs (6 bytes a key) in place of one row a key: a task
gathers up to ``FLUSH`` keys, sorts them by bucket and sends one row a bucket.

1. A bucket's task finds the keys that occur twice.  A task's keys are made unique
   before they are sent, so a key of very many documents weighs one entry a flush.
2. The blobs, now with document ids, are dealt by bucket and read after the shared
   keys of their bucket (``_beside``).  A join would send these keys with each blob,
   and both grow with the input.  A flush sends a key once a document, so a hot key
   weighs one entry a document.

Keys are folded to bucket and 48 bits, so a key may be reported that only shares
its fold; callers verify what they find.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

FLUSH = 1 << 20
_LOW = np.uint64((1 << 48) - 1)
_HIGH = np.uint64(48)

#: Yields (document ids, keys) for Arrow batches of documents.
Emit = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]


def bucket_count(df: DataFrame) -> int:
    """Several buckets a shuffle partition, which the cluster's settings make fit the data."""
    return min(1 << 16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fold(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> _HIGH) % np.uint64(buckets) << _HIGH | keys & _LOW


def _pack(keys: np.ndarray, width: int = 6) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _unpack(raw: bytes, width: int = 6) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _gathered(rows: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Tuples of equally long arrays, joined until they hold ``FLUSH`` entries."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= FLUSH:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _flushes(emit: Emit, batches, buckets: int):
    return _gathered((np.asarray(i, np.int64), fold(k, buckets)) for i, k in emit(batches))


def _by_bucket(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their offsets in sorted keys)."""
    return _runs((keys >> _HIGH).astype(np.int64))


def _runs(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, their offsets) of sorted buckets."""
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return buckets[first], np.append(first, len(buckets))


def _beside(table: DataFrame, blobs: DataFrame) -> DataFrame:
    """The rows of ``blobs`` by bucket ``b``, after the row that ``table`` has for the bucket (``head``)."""
    both = table.withColumn("head", F.lit(True)).unionByName(blobs.withColumn("head", F.lit(False)), allowMissingColumns=True)
    return both.repartition("b").sortWithinPartitions("b", F.desc("head"))


#: Bytes of blobs that meet a table at a time.
MEET_BYTES = 1 << 20


def _met(batches, load: Callable[[pa.RecordBatch], object], column: str):
    """(bucket, what ``load`` makes of its table's row, blobs with about ``MEET_BYTES`` of ``column``) of the rows of
    ``_beside``; a table is loaded once, and a bucket without one is left out."""
    at, have = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, head = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "head"))
        group = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64) // MEET_BYTES
        new = (b[1:] != b[:-1]) | (head[1:] != head[:-1]) | (group[1:] != group[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if head[a]:
                at, have = b[a], load(batch.slice(a, 1))
            elif at == b[a]:
                yield at, have, batch.slice(a, z - a)


def _squeeze(x: np.ndarray) -> bytes:
    """Integers as differences, byte planes apart, compressed: about a byte for each of slowly growing ones."""
    steps = np.diff(x, prepend=np.int64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _stretch(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.int64))


def shared_keys(rows: DataFrame, emit: Emit, buckets: int) -> DataFrame:
    """(doc_id, keys array<long>): folded keys of each document that another document may have as well."""

    def seen(batches):
        for ids, keys in _flushes(emit, batches, buckets):
            order = np.lexsort((ids, keys))
            ids, keys = ids[order], keys[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(keys)) - 1
            unique = np.repeat(keys[first], 1 + (ids[first] != ids[last]))  # twice: already shared
            raw = _pack(unique)
            at, cut = _by_bucket(unique)
            yield pa.record_batch({"b": pa.array(at.astype(np.int32)), "raw": pa.array([raw[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def twice(table: pa.Table) -> pa.Table:
        keys = np.sort(_unpack(b"".join(table.column("raw").to_pylist())))
        keys = np.unique(keys[1:][keys[1:] == keys[:-1]])
        n = 1 if len(keys) else 0
        return pa.table({"b": table.column("b")[:n], "raw": pa.array([_pack(keys).tobytes()][:n], pa.binary())})

    def sent(batches):
        for ids, keys in _flushes(emit, batches, buckets):
            # by bucket, then by document: runs of one id compress well
            order = np.lexsort((keys, ids, keys >> _HIGH))
            ids, keys = ids[order], keys[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
            ids, keys = ids[new], keys[new]
            raw = _pack(keys)
            at, cut = _by_bucket(keys)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield pa.record_batch({"b": pa.array(at.astype(np.int32)), "raw": pa.array([raw[a:z].tobytes() for a, z in spans], pa.binary()), "ids": pa.array([ids[a:z].tobytes() for a, z in spans], pa.binary())})

    def hits(batches):
        for b, have, blobs in _met(batches, lambda row: _unpack(row.column("raw")[0].as_py()), "raw"):
            keys, ids = _unpack(b"".join(blobs.column("raw").to_pylist())), np.frombuffer(b"".join(blobs.column("ids").to_pylist()), np.int64)
            at = np.searchsorted(have, keys)
            at[at == len(have)] = 0
            good = have[at] == keys
            keys, ids = keys[good] | np.uint64(b) << _HIGH, ids[good]
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            yield pa.record_batch({"doc_id": pa.array(ids[first]), "keys": pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(keys.view(np.int64)))})

    shared = stored(rows.mapInArrow(seen, "b int, raw binary").groupBy("b").applyInArrow(twice, "b int, raw binary"), "shared-keys")
    found = _beside(shared, rows.mapInArrow(sent, "b int, raw binary, ids binary")).mapInArrow(hits, "doc_id long, keys array<long>")
    return found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))


#: Steps of a key's code an octave of its count, and the code of keys that are not counted.
STEPS, UNCOUNTED = 4, 120


def code(keys: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """64-bit codes of 48-bit keys that sort by ``kind`` (below 128), then by key."""
    return (kind.astype(np.int64) << 56) | (keys.astype(np.int64) << 8)


def counted_keys(rows: DataFrame, column: str, limit: int, buckets: int) -> DataFrame:
    """(id, codes array<long>): of each row's distinct 48-bit keys (packed, 6 bytes each, in ``column``) those that
    another row has too, as codes.  Keys below ``limit`` sort by how many rows have them, in quarter octaves, and
    come before all others, which sort by themselves.

    The same moves as in ``shared_keys``; a flush sends a key once, with a byte for its count.
    """

    def flushes(batches):
        for ids, keys in _gathered((np.full(len(raw) // 6, i, np.int64), _unpack(raw)) for b in batches for i, raw in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), strict=True)):
            yield ids, (keys % np.uint64(buckets) << _HIGH) | keys

    def seen(batches):
        for _, keys in flushes(batches):
            keys, n = np.unique(keys, return_counts=True)
            raw, log = _pack(keys), np.minimum(255, 8 * np.log2(n)).astype(np.uint8)
            at, cut = _by_bucket(keys)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield pa.record_batch({"b": pa.array(at.astype(np.int32)), "raw": pa.array([raw[a:z].tobytes() for a, z in spans], pa.binary()), "n": pa.array([log[a:z].tobytes() for a, z in spans], pa.binary())})

    def merge(batches):
        for table in runs(batches, "b"):
            keys = _unpack(b"".join(table.column("raw").to_pylist()))
            n = np.exp2(np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint8) / 8)
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            total = np.add.reduceat(n, first)
            keep = total > 1.5
            if keep.any():
                kind = np.minimum(UNCOUNTED - 1, STEPS * np.log2(total[keep])).astype(np.uint8)
                yield pa.record_batch({"b": table.column("b")[:1].combine_chunks(), "shared": pa.array([_pack(keys[first[keep]]).tobytes()], pa.binary()), "kind": pa.array([kind.tobytes()], pa.binary())})

    def sent(batches):
        for ids, keys in flushes(batches):
            order = np.lexsort((ids, keys >> _HIGH))
            ids, keys = ids[order], keys[order]
            raw = _pack(keys)
            at, cut = _by_bucket(keys)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield pa.record_batch({"b": pa.array(at.astype(np.int32)), "raw": pa.array([raw[a:z].tobytes() for a, z in spans], pa.binary()), "ids": pa.array([_squeeze(ids[a:z]) for a, z in spans], pa.binary())})

    def hits(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, ids = _unpack(batch.column(0)[i].as_py()), _stretch(batch.column(1)[i].as_py())
                have, kind = _unpack(batch.column(2)[i].as_py()), np.frombuffer(batch.column(3)[i].as_py(), np.uint8)
                at = np.searchsorted(have, keys)
                at[at == len(have)] = 0
                good = have[at] == keys
                keys, ids, at = keys[good], ids[good], at[good]
                if not len(keys):
                    continue
                codes = code(keys, np.where(keys < limit, kind[at], UNCOUNTED))
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                yield pa.record_batch({"id": pa.array(ids[first]), "codes": pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(codes))})

    id_col = rows.columns[0]
    rows = rows.select(F.col(id_col).alias("id"), column)
    first = rows.mapInArrow(seen, "b int, raw binary, n binary").repartition("b").sortWithinPartitions("b")
    shared = stored(first.mapInArrow(merge, "b int, shared binary, kind binary"), "shared-keys", 64)
    found = rows.mapInArrow(sent, "b int, raw binary, ids binary").join(shared, "b").select("raw", "ids", "shared", "kind").mapInArrow(hits, "id long, codes array<long>")
    return found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("codes"))).alias("codes"))


def runs(batches, key: str):
    """Tables of the rows of each key; the rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.schema.get_field_index(key)
        k = batch.column(at).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(at)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


#: Yields (document ids, parts, keys) for Arrow batches of rows with places.
EmitPlaces = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]
#: Bytes kept of a key whose bucket is known.
PLACE_KEY = 7


def first_holders(rows: DataFrame, emit: EmitPlaces, buckets: int) -> DataFrame:
    """(doc_id, part, ref_id, ref_part), distinct: each place (doc_id, part), and the first place of a key of it,
    where that is a place of a smaller document.

    The first table holds one packed row a bucket: the first place of each key that several documents have.  A
    task sends a key once a flush, so a key of very many places weighs one entry a flush.  All places are then
    dealt by bucket and read after its row of the table (``_beside``); a flush sends a key of a place once.
    """
    kind = "b int, keys binary, ids binary, parts binary"

    def blobs(ids, parts, keys, *more):
        bucket = ((keys >> _HIGH) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((keys, parts, ids, bucket))
        new = [x[order][1:] != x[order][:-1] for x in (ids, parts, keys)]
        order = order[np.concatenate([[True], new[0] | new[1] | new[2]])]
        at, cut = _runs(bucket[order])
        spans = [order[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        columns = {
            "b": pa.array(at),
            "keys": pa.array([_pack(keys[o], PLACE_KEY).tobytes() for o in spans], pa.binary()),
            "ids": pa.array([_squeeze(ids[o]) for o in spans], pa.binary()),
            "parts": pa.array([_squeeze(parts[o]) for o in spans], pa.binary()),
        }
        return pa.record_batch(columns | {f"more{i}": pa.array([np.packbits(x[o]).tobytes() for o in spans], pa.binary()) for i, x in enumerate(more)})

    def held(row):
        keys = _unpack(row["keys"], PLACE_KEY)
        return _stretch(row["ids"]), _stretch(row["parts"]), keys

    def seen(batches):
        for ids, parts, keys in _gathered(emit(batches)):
            order = np.lexsort((parts, ids, keys))
            ids, parts, keys = ids[order], parts[order], keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            last = np.append(first[1:], len(keys)) - 1
            yield blobs(ids[first], parts[first], keys[first], ids[first] != ids[last])

    def merge(table: pa.Table) -> pa.Table:
        got = [(*held(row), row["more0"]) for row in table.to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(k)] for _, _, k, m in got]).astype(bool)
        ids, parts, keys = (np.concatenate([g[i] for g in got]) for i in range(3))
        order = np.lexsort((parts, ids, keys))
        ids, parts, keys, several = ids[order], parts[order], keys[order], several[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        last = np.append(first[1:], len(keys)) - 1
        keep = first[np.logical_or.reduceat(several, first) | (ids[first] != ids[last])]
        keep = keep[np.lexsort((parts[keep], ids[keep]))]  # in the order of places, which squeezes well
        n = 1 if len(keep) else 0
        return pa.table({"b": table.column("b")[:n], "keys": pa.array([_pack(keys[keep], PLACE_KEY).tobytes()][:n], pa.binary()), "ids": pa.array([_squeeze(ids[keep])][:n], pa.binary()), "parts": pa.array([_squeeze(parts[keep])][:n], pa.binary())})

    def sent(batches):
        for places in _gathered(emit(batches)):
            yield blobs(*places)

    def ask(batches):
        def load(row):
            ref_ids, ref_parts, have = held(row.to_pylist()[0])
            order = np.argsort(have)
            return have[order], ref_ids[order], ref_parts[order]

        for _, (have, ref_ids, ref_parts), blobs in _met(batches, load, "keys"):
            ids, parts, keys = (np.concatenate(x) for x in zip(*map(held, blobs.to_pylist()), strict=True))
            at = np.searchsorted(have, keys)
            at[at == len(have)] = 0
            good = (have[at] == keys) & (ref_ids[at] < ids)
            if not good.any():
                continue
            found = np.stack([ids[good], parts[good], ref_ids[at[good]], ref_parts[at[good]]])
            found = found[:, np.lexsort(found)]
            found = found[:, np.concatenate([[True], (found[:, 1:] != found[:, :-1]).any(axis=0)])]
            yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in found], ["doc_id", "part", "ref_id", "ref_part"])

    first = stored(rows.mapInArrow(seen, f"{kind}, more0 binary").groupBy("b").applyInArrow(merge, kind), "first-places")
    return _beside(first, rows.mapInArrow(sent, kind)).mapInArrow(ask, "doc_id long, part long, ref_id long, ref_part long").distinct()
