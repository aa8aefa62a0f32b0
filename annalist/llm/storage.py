"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Drops a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests), a folder below the warehouse."""
    at = spark.conf.get(_SETTING, None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set(_SETTING, at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of the Arrow batches that Python sees while a table is written.
BATCH_ROWS = 2000
_open = threading.local()


def stored(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go as it ends, since nothing reads them again; while it
    runs they serve retries.  ``batch_rows``: rows of Arrow batches, fewer for rows that may be large.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    changes = {_CLEANUP: "true", _BATCH: str(batch_rows)}
    old = {name: spark.conf.get(name) for name in changes}
    try:
        for name, value in changes.items():
            spark.conf.set(name, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for held in getattr(_open, "scopes", []):
        held.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was derived from them has been stored."""
    for df in tables:
        if getattr(df, "stored_at", None):
            _delete(df.sparkSession, df.stored_at)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that this thread stores inside it, but for those that are given to the yielded function."""
    held: list[str] = []
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    _open.scopes.append(held)

    def keep(df: DataFrame) -> DataFrame:
        held.remove(df.stored_at)
        return df

    try:
        yield keep
    finally:
        _open.scopes.remove(held)
        for path in held:
            _delete(spark, path)


#: Bits of the id filter below for each id, and its bits at least and at most (8 MiB).  Beyond these
#: it is left out, and Spark's own runtime filters serve the join that follows.
FILTER_BITS, LEAST_BITS, MOST_BITS = 8, 22, 26


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def only_near(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id may be in ``ids``: a one-hash Bloom filter that grows with the ids, applied
    before a join shuffles the texts.  It never drops a row whose id is in ``ids``; a join on the
    exact ids has to follow.  The bits come to the driver as at most 256 slices.
    """
    spark = docs.sparkSession
    width = max(LEAST_BITS, (FILTER_BITS * ids.count()).bit_length())
    if width > MOST_BITS:
        return docs
    slots = 1 << width
    per = slots // 256

    def bits(batches):
        full = np.zeros(slots, bool)
        for b in batches:
            c = b.column(0).drop_null()
            full[_slot(c.to_numpy(zero_copy_only=False), width)] = True
        packed = [(i, np.packbits(full[i * per : (i + 1) * per]).tobytes()) for i in range(256) if full[i * per : (i + 1) * per].any()]
        yield pa.record_batch({"i": pa.array([i for i, _ in packed], pa.int32()), "b": pa.array([b for _, b in packed], pa.binary())})

    def merge(table):
        total = np.zeros(per // 8, np.uint8)
        for b in table.column("b").to_pylist():
            total |= np.frombuffer(b, np.uint8)
        return pa.table({"i": table.column("i")[:1].cast(pa.int32()), "b": pa.array([total.tobytes()], pa.binary())})

    rows = ids.select(F.col(id_col).cast("long").alias("i")).mapInArrow(bits, "i int, b binary").groupBy("i").applyInArrow(merge, "i int, b binary").collect()
    full = np.zeros(slots // 8, np.uint8)
    for r in rows:
        full[r.i * (per // 8) : (r.i + 1) * (per // 8)] = np.frombuffer(bytes(r.b), np.uint8)
    held = spark.sparkContext.broadcast(full.tobytes())
    at = docs.columns.index(id_col)

    def keep(batches):
        have = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for b in batches:
            c = b.column(at)
            known = pc.is_valid(c).to_numpy(zero_copy_only=False)
            mask = np.zeros(len(c), bool)
            mask[known] = have[_slot(c.drop_null().to_numpy(zero_copy_only=False), width)]
            yield b.filter(pa.array(mask))

    return docs.mapInArrow(keep, docs.schema)
