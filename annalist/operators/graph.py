"""Commit-graph operators over ``edges`` (child, parent, ord).

A closure is a fixed point.  Graphs of a checked size (``WALK_EDGES``) are walked in
one task, which needs no job a level; larger ones use a semi-naive loop of joins
whose rounds are written to the shared checkpoint folder.  Both give the same rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a graph that one task walks: about 550 MB of a worker's memory.
WALK_EDGES = 16_000_000
#: Edges of a graph whose generations one task finds: about 1 GB of a worker's memory.
TASK_EDGES = 5_000_000


def _checkpoint_dir(spark) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints").rstrip("/")


def _checkpointed(df: DataFrame, at: str | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder (below ``at``), read back.

    ``DataFrame.checkpoint`` computes its rows twice, and what it returns keeps constraints on columns of the
    plan it cuts off: a union of such tables fails as soon as the plan filters.
    """
    path = f"{at or _checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_edges(edges: DataFrame) -> DataFrame:
    """``edges`` for several uses: walks over them read them again and do not make them again."""
    return _checkpointed(edges)


def _forget(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Rows of a record batch that a walk yields.
BATCH_ROWS = 1 << 18


class _Graph:
    """Parents of nodes as offsets: about 32 bytes an edge while it is made, 12 later."""

    def __init__(self, child: list[np.ndarray], parent: list[np.ndarray]):
        """Arrays of edges; the lists are emptied."""
        none = np.zeros(0, np.int64)
        own = np.concatenate([none, *child])
        child.clear()
        up = np.concatenate([none, *parent])
        parent.clear()
        order = np.argsort(own, kind="stable")
        up = up[order]
        own = own[order]
        del order
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
        self.first, self.child = np.append(first, len(own)), own[first]
        del own
        at = np.searchsorted(self.child, up)
        at[at == len(self.child)] = 0
        root = self.child[at] != up if len(up) else np.zeros(0, bool)
        self.roots = np.unique(up[root])
        at[root] = len(self.child) + np.searchsorted(self.roots, up[root])
        self.up = at.astype(np.int32)
        self.n = len(self.child) + len(self.roots)

    def node(self, i: int) -> int | None:
        for ids, shift in ((self.child, 0), (self.roots, len(self.child))):
            at = int(np.searchsorted(ids, i))
            if at < len(ids) and ids[at] == i:
                return shift + at
        return None

    def ids(self, nodes: np.ndarray) -> np.ndarray:
        inner = nodes < len(self.child)
        out = np.empty(len(nodes), np.int64)
        out[inner] = self.child[nodes[inner]]
        out[~inner] = self.roots[nodes[~inner] - len(self.child)]
        return out

    def parents(self, nodes: np.ndarray) -> np.ndarray:
        nodes = nodes[nodes < len(self.child)]
        low, many = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        shift = np.cumsum(many) - many
        return self.up[np.repeat(low - shift, many) + np.arange(int(many.sum()))]

    def levels(self, start: int, seen: np.ndarray):
        """Nodes by distance from ``start``; marks them in ``seen``."""
        level = np.array([start], np.int32)
        seen[start] = True
        while len(level):
            yield level
            level = self.parents(level)
            level = np.unique(level[~seen[level]])
            seen[level] = True


#: Edges of a packed row.
PACKED = 1 << 18


def _pack(batches):
    """Rows (kind, a, z) of edges as rows of many; one task reads those far faster."""
    held, size = [], 0

    def row(part):
        a, z = (np.concatenate(x) for x in zip(*part, strict=True))
        return pa.record_batch({"a": pa.array([a.tobytes()], pa.binary()), "z": pa.array([z.tobytes()], pa.binary())})

    for b in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns))
        size += b.num_rows
        if size >= PACKED:
            yield row(held)
            held, size = [], 0
    if size:
        yield row(held)


def _one_task(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """(kind, a, z) in one partition, as ``_read`` takes it: packed edges (child, parent), and tips (tip, id) likewise."""
    kind = "a binary, z binary"
    rows = [x.select(*(F.col(c).cast("long") for c in x.columns)).mapInArrow(_pack, kind).select(F.lit(k).alias("kind"), "a", "z") for k, x in ((False, edges.select("child", "parent")), (True, tips.select("tip", "id")))]
    return rows[0].unionAll(rows[1]).repartition(1)


def _read(batches) -> tuple[_Graph, list[tuple[int, int]]]:
    child, parent, tips = [], [], []
    for b in batches:
        for kind, a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            a, z = np.frombuffer(a, np.int64), np.frombuffer(z, np.int64)
            if kind:
                tips += zip(a.tolist(), z.tolist(), strict=True)
            else:
                child.append(a)
                parent.append(z)
    return _Graph(child, parent), tips


def _walk(batches):
    graph, tips = _read(batches)
    seen, held, size = np.zeros(graph.n, bool), [], 0

    def batch(rows):
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["tip", "id", "depth"])

    for tip, start in sorted(tips):
        at = graph.node(start)
        walked = [] if at is None else list(graph.levels(at, seen))
        ids = np.array([start], np.int64) if at is None else graph.ids(np.concatenate(walked))
        depth = np.repeat(np.arange(max(1, len(walked))), [len(x) for x in walked] or [1])
        for x in walked:
            seen[x] = False
        for i in range(0, len(ids), BATCH_ROWS):
            part = ids[i : i + BATCH_ROWS]
            held.append((np.full(len(part), tip, np.int64), part, depth[i : i + BATCH_ROWS]))
            size += len(part)
            if size >= BATCH_ROWS:
                yield batch(held)
                held, size = [], 0
    if held:
        yield batch(held)


def closure(edges: DataFrame, tips: DataFrame, first_parent: bool = False, task_edges: int = WALK_EDGES) -> DataFrame:
    """(tip, id, depth): everything reachable from each tip (tip, id), itself included, with the shortest distance."""
    made = getattr(edges, "stored_at", None)
    if first_parent:
        edges = edges.where("ord = 0")
    edges = edges.select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent")).where("child is not null")
    tips = tips.select(F.col("tip").cast("long").alias("tip"), F.col("id").cast("long").alias("id"))
    spark = edges.sparkSession
    at = f"{_checkpoint_dir(spark)}/walk-{uuid.uuid4().hex}"
    # edges and result are stored: both are costly, and a plan may hold the result several times
    held = edges if made else _checkpointed(edges, f"{at}/edges")
    if held.count() <= task_edges:
        seen = _checkpointed(_one_task(held, tips).mapInArrow(_walk, "tip long, id long, depth long"), f"{at}/seen")
    else:
        frontier = _checkpointed(tips.withColumn("depth", F.lit(0).cast("long")).distinct(), f"{at}/seen")
        while True:
            # one round's rows are one folder
            seen = spark.read.schema(frontier.schema).option("recursiveFileLookup", "true").parquet(f"{at}/seen")
            if frontier.isEmpty():
                break
            after = frontier.join(held, F.col("id") == F.col("child")).select("tip", F.col("parent").alias("id"), (F.col("depth") + 1).alias("depth")).distinct()
            frontier = _checkpointed(after.join(seen.select("tip", "id"), ["tip", "id"], "left_anti").select("tip", "id", "depth"), f"{at}/seen")
    if not made:
        _forget(spark, f"{at}/edges")
    return seen


def difference(reached: DataFrame, include: list[int], exclude: list[int]) -> DataFrame:
    """Ids reached from an included tip and from no excluded one."""
    inside = reached.where(F.col("tip").isin(include)).select("id").distinct()
    return inside.join(reached.where(F.col("tip").isin(exclude)).select("id"), "id", "left_anti")


def symmetric(reached: DataFrame, left: int, right: int) -> DataFrame:
    """(id, side) of what exactly one of two tips reaches."""
    both = reached.where(F.col("tip").isin(left, right)).groupBy("id").agg(F.min("tip").alias("low"), F.count(F.lit(1)).alias("n"))
    return both.where("n = 1").select("id", F.when(F.col("low") == left, "<").otherwise(">").alias("side"))


def merge_bases(edges: DataFrame, reached: DataFrame, tips: list[int]) -> DataFrame:
    """Common ancestors of all tips that are no ancestor of another common one.

    A common ancestor's ancestors are common too, so the ones to drop are the
    direct parents of common ancestors.
    """
    common = reached.where(F.col("tip").isin(tips)).groupBy("id").agg(F.countDistinct("tip").alias("n")).where(F.col("n") == len(tips)).select("id")
    lower = edges.join(common, F.col("child") == F.col("id")).select(F.col("parent").alias("id"))
    return common.join(lower, "id", "left_anti")


def merge_bases_with(edges: DataFrame, reached: DataFrame, one: int, others: list[int]) -> DataFrame:
    """Best common ancestors of tip ``one`` and a commit whose parents were ``others``."""
    rest = reached.where(F.col("tip").isin(others)).select("id")
    common = reached.where(F.col("tip") == one).select("id").join(rest, "id", "left_semi")
    lower = edges.join(common, F.col("child") == F.col("id")).select(F.col("parent").alias("id"))
    return common.join(lower, "id", "left_anti")


def ahead_behind(reached: DataFrame, left: int, right: int) -> DataFrame:
    return symmetric(reached, left, right).agg(F.count_if(F.col("side") == "<").alias("ahead"), F.count_if(F.col("side") == ">").alias("behind"))


def boundary(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Parents of selected commits that are not selected."""
    up = edges.join(selected, F.col("child") == F.col("id")).select(F.col("parent").alias("id")).distinct()
    return up.join(selected, "id", "left_anti")


def independent(edges: DataFrame, reached: DataFrame, tips: DataFrame) -> DataFrame:
    """Tips that no other tip reaches."""
    other = reached.join(tips.select(F.col("tip").alias("own"), "id"), "id").where("own <> tip").select("own")
    return tips.join(other, F.col("tip") == F.col("own"), "left_anti").select("tip", "id")


def _generations(batches):
    parents, nodes = defaultdict(list), set()
    for b in batches:
        for c, p in zip(*(x.to_pylist() for x in b.columns), strict=True):
            nodes.add(c)
            if p is not None:
                parents[c].append(p)
                nodes.add(p)
    level: dict[int, int] = {}
    for start in nodes:
        stack = [start]
        while stack:
            n = stack[-1]
            if n in level:
                stack.pop()
                continue
            todo = [p for p in parents.get(n, ()) if p not in level]
            if todo:
                stack.extend(todo)
            else:
                level[n] = 1 + max((level[p] for p in parents.get(n, ())), default=0)
                stack.pop()
    yield pa.record_batch({"id": pa.array(list(level), pa.int64()), "generation": pa.array(list(level.values()), pa.int64())})


def generations(edges: DataFrame, commits: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, generation): 1 for roots, else one more than the largest of the parents."""
    if edges.limit(task_edges + 1).count() <= task_edges:
        rows = commits.select(F.col("id").cast("long").alias("c"), F.lit(None).cast("long").alias("p")).unionAll(edges.select("child", "parent"))
        return rows.repartition(1).mapInArrow(_generations, "id long, generation long")
    level = _checkpointed(commits.select("id", F.lit(1).cast("long").alias("generation")))
    while True:
        up = edges.join(level, F.col("parent") == F.col("id")).groupBy("child").agg((F.max("generation") + 1).alias("g"))
        new = _checkpointed(level.join(up, F.col("id") == F.col("child"), "left").select("id", F.greatest("generation", F.coalesce("g", F.lit(1))).alias("generation")))
        if new.agg(F.sum("generation")).first()[0] == level.agg(F.sum("generation")).first()[0]:
            return new
        level = new


#: Bytes of the bit sets that ``_weights`` holds at once.
BITS = 128 << 20


def _weights(batches):
    """(id, weight): how many nodes each tip reaches, by bit sets of a block of nodes at a time; parents come first."""
    graph, tips = _read(batches)
    waiting, kids = np.diff(graph.first).tolist(), defaultdict(list)
    for child, (a, z) in enumerate(zip(graph.first[:-1].tolist(), graph.first[1:].tolist(), strict=True)):
        for p in graph.up[a:z].tolist():
            kids[p].append(child)
    order = list(range(len(graph.child), graph.n))
    for p in order:
        for c in kids.get(p, ()):
            waiting[c] -= 1
            if not waiting[c]:
                order.append(c)
    weight = np.zeros(graph.n, np.int64)
    width = max(64, BITS // max(1, graph.n) * 8 // 64 * 64)
    for low in range(0, graph.n, width):
        bits = np.zeros((graph.n, min(width, -(-(graph.n - low) // 64) * 64) // 64), np.uint64)
        for i in order:
            if i < len(graph.child):
                for p in graph.up[graph.first[i] : graph.first[i + 1]].tolist():
                    bits[i] |= bits[p]
            if low <= i < low + width:
                bits[i, (i - low) // 64] |= np.uint64(1 << (i - low) % 64)
        for i in range(0, graph.n, 4096):
            weight[i : i + 4096] += np.bitwise_count(bits[i : i + 4096]).sum(axis=1, dtype=np.int64)
    found = [(tip, 1 if (at := graph.node(i)) is None else int(weight[at])) for tip, i in tips]
    yield pa.record_batch({"tip": pa.array([x for x, _ in found], pa.int64()), "weight": pa.array([w for _, w in found], pa.int64())})


#: Edges of a selection whose weights one task finds.
WEIGHT_EDGES = 500_000


def bisect_weights(edges: DataFrame, selected: DataFrame, task_edges: int = WEIGHT_EDGES) -> DataFrame:
    """(id, weight, distance): commits of ``selected`` that each reaches inside it; the best has the largest distance."""
    inside = edges.join(selected, F.col("child") == F.col("id")).drop("id").join(selected, F.col("parent") == F.col("id"), "left_semi")
    inside = _checkpointed(inside.select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent"), "ord"))
    tips = selected.select(F.col("id").cast("long").alias("tip"), F.col("id").cast("long").alias("id"))
    n = selected.select(F.count(F.lit(1)).alias("n"))
    if inside.count() <= task_edges:
        weights = _one_task(inside, tips).mapInArrow(_weights, "tip long, weight long")
    else:
        weights = closure(inside, tips).groupBy("tip").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(F.broadcast(n)).select(F.col("tip").alias("id"), "weight", F.least("weight", F.col("n") - F.col("weight")).alias("distance"))
