"""Orders of a history, describe, ancestry paths, blame and renames."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.text_diff import myers

from . import graph


def ordered(commits: DataFrame, edges: DataFrame, order: str = "date") -> DataFrame:
    """(id, rank) of ``commits`` (id, time: long): no parent before a child.

    ``date``: of what may come next, the newest (ties: the larger id).  ``topo``: lines of history stay together;
    after a commit come its parents, the last parent first.  Give the author's time as ``time`` for an author-date order.
    The order is a sequence, so one task makes it: 16 bytes a commit and an edge in its memory.
    """

    def run(batches):
        time, parents, waiting = {}, defaultdict(list), defaultdict(int)
        for b in batches:
            for kind, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind:
                    parents[a].append(z)
                else:
                    time[a] = z
        for child, ps in parents.items():
            if child in time:
                for p in ps:
                    waiting[p] += p in time
        ready = sorted(((-t, -i, i) for i, t in time.items() if not waiting[i]))
        out = []
        stack = [r[2] for r in reversed(ready)]
        while ready if order == "date" else stack:
            i = heapq.heappop(ready)[2] if order == "date" else stack.pop()
            out.append(i)
            for p in parents.get(i, ()):
                if p in time:
                    waiting[p] -= 1
                    if not waiting[p]:
                        heapq.heappush(ready, (-time[p], -p, p)) if order == "date" else stack.append(p)
        yield pa.record_batch({"id": pa.array(out, pa.int64()), "rank": pa.array(range(1, len(out) + 1), pa.int64())})

    if order not in ("date", "topo"):
        raise ValueError(f"unknown order {order!r}")
    rows = commits.select(F.lit(False).alias("kind"), F.col("id").cast("long").alias("a"), F.col("time").cast("long").alias("z"))
    rows = rows.unionByName(edges.select(F.lit(True).alias("kind"), F.col("child").cast("long").alias("a"), F.col("parent").cast("long").alias("z"), "ord").orderBy("a", "ord").drop("ord"))
    return rows.coalesce(1).mapInArrow(run, "id long, rank long")


def describe(edges: DataFrame, tips: DataFrame, tags: DataFrame, candidates: int = 10) -> DataFrame:
    """(tip, tag, depth): the tag with the fewest commits of the tip that it doesn't hold, among the ``candidates`` newest reachable tags
    (id, name, time); null if there is none."""
    reached = graph.closure(edges, tips).select("tip", "id")
    newest = Window.partitionBy("tip").orderBy(F.desc("time"), F.desc("id"), "name")
    near = reached.join(tags, "id").withColumn("i", F.row_number().over(newest)).where(F.col("i") <= candidates)
    near = graph.stored_edges(near)
    inside = graph.closure(edges, near.select(F.col("id").alias("tip"), "id").distinct()).groupBy(F.col("tip").alias("id")).agg(F.count(F.lit(1)).alias("held"))
    size = reached.groupBy("tip").agg(F.count(F.lit(1)).alias("size"))
    depths = near.join(inside, "id").join(size, "tip").withColumn("depth", F.col("size") - F.col("held"))
    best = depths.groupBy("tip").agg(F.min(F.struct("depth", "i", "name")).alias("b"))
    return tips.select("tip").join(best, "tip", "left").select("tip", F.col("b.name").alias("tag"), F.col("b.depth").alias("depth"))


def ancestry_path(edges: DataFrame, reached: DataFrame, bottom: DataFrame) -> DataFrame:
    """(tip, id) of ``reached`` that are descendants of a commit of ``bottom`` (id), those themselves left out."""
    # ways from ``reached`` down stay in it, so no edge outside is walked, and one walk serves all of ``bottom``
    held = reached.select(F.col("id").alias("child")).distinct()
    up = edges.join(held, "child", "left_semi").select(F.col("parent").alias("child"), F.col("child").alias("parent"), "ord")
    above = graph.closure(up, bottom.select(F.lit(0).alias("tip"), "id")).select("id").distinct()
    return reached.join(above, "id", "left_semi").join(bottom.select("id"), "id", "left_anti").select("tip", "id")


def object_closure(reached: DataFrame, commits: DataFrame, trees: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """(oid, type): commits of ``reached`` (id) and what their trees hold, without the objects of ``cut`` (id)."""
    ids = reached.select("id").distinct()

    def objects(of: DataFrame) -> DataFrame:
        own = commits.join(of, "id", "left_semi").select("oid", F.lit("commit").alias("type"))
        held = trees.join(of.select(F.col("id").alias("commit_id")), "commit_id", "left_semi").select("oid", F.lit("blob").alias("type"))
        return own.unionByName(held).distinct()

    found = objects(ids)
    return found if cut is None else found.join(objects(cut.select("id").distinct()), ["oid", "type"], "left_anti")


def last_changed(trees: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, commit_id): the newest commit (id, time) whose blob at the path differs from its first parent's."""
    first = edges.where("ord = 0").select(F.col("child").alias("commit_id"), F.col("parent"))
    before = trees.select(F.col("commit_id").alias("parent"), "path", F.col("oid").alias("old"))
    changed = trees.join(first, "commit_id", "left").join(before, ["parent", "path"], "left").where("old is null or old <> oid")
    dated = changed.join(commits.select(F.col("id").alias("commit_id"), "time"), "commit_id")
    return dated.groupBy("path").agg(F.max_by("commit_id", F.struct("time", "commit_id")).alias("commit_id"))


def unreachable(commits: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``commits`` outside of everything that ``roots`` (id) reach; ids are positive."""
    top = F.lit(-1).cast("long")  # a commit above all roots
    above = edges.select("child", "parent", "ord").unionByName(roots.select(top.alias("child"), F.col("id").alias("parent"), F.lit(0).alias("ord")).distinct())
    tip = edges.sparkSession.createDataFrame([(1, -1)], "tip long, id long")
    return commits.join(graph.closure(above, tip).select("id"), "id", "left_anti")


def blame(versions: DataFrame) -> DataFrame:
    """(path, line, text, version): for each line of a path's newest version (path, version: long, text) the version that brought it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lines, origin = [], []
        for version, text in rows.sort_values("version")[["version", "text"]].itertuples(index=False):
            new, since, x, y = (text or "").split("\n"), [], 0, 0
            for op, n in myers(lines, new):
                since += origin[x : x + n] if op == "=" else [version] * n if op == "+" else []
                x, y = x + n * (op != "+"), y + n * (op != "-")
            lines, origin = new, since
        return pd.DataFrame({"path": rows["path"].iloc[0], "line": range(1, len(lines) + 1), "text": lines, "version": origin})

    path = versions.schema["path"].dataType.simpleString()
    return versions.groupBy("path").applyInPandas(run, f"path {path}, line long, text string, version long")


def renames(deleted: DataFrame, added: DataFrame, least: int = 50, within: Column | None = None) -> DataFrame:
    """(old, new, score): for each added path (path, text) the deleted one that is most like it, in percent of ``least`` or more.

    Likeness: bytes of lines that both hold (as often as both do) by the larger size.  Pairs meet on their lines, so
    unlike pairs are never formed; a line's bytes are summed before pairs are compared.
    """

    def lines(df: DataFrame, name: str) -> DataFrame:
        cut = df.select(F.col("path").alias(name), F.octet_length("text").alias(f"{name}_size"), F.explode(F.split("text", "\n")).alias("line"))
        return cut.groupBy(name, f"{name}_size", F.xxhash64("line").alias("h"), (F.octet_length("line") + 1).alias("bytes")).agg(F.count(F.lit(1)).alias(f"{name}_n"))

    both = lines(deleted, "old").join(lines(added, "new"), ["h", "bytes"]).where(F.least("old_size", "new_size") * 100 >= F.greatest("old_size", "new_size") * least)
    same = both.groupBy("old", "new", "old_size", "new_size").agg(F.sum(F.least("old_n", "new_n") * F.col("bytes")).alias("same"))
    scored = same.withColumn("score", F.least(F.lit(100), F.floor(F.col("same") * 100 / F.greatest(F.col("old_size") + 1, F.col("new_size") + 1))).cast("int")).where(F.col("score") >= least)
    best = scored.groupBy("new").agg(F.min(F.struct((-F.col("score")).alias("k"), "old", "score")).alias("b"))
    return best.select("b.old", "new", "b.score")


def fork_points(edges: DataFrame, tips: DataFrame, past: DataFrame) -> DataFrame:
    """(tip, id): the only best common ancestor of a tip (tip, id) and a merge of all ``past`` values (id) of a ref, if it is one of them; ids are positive."""
    top = F.lit(-1).cast("long")  # the merge of the past values
    above = edges.select("child", "parent", "ord").unionByName(past.select(top.alias("child"), F.col("id").alias("parent"), F.lit(0).alias("ord")).distinct())
    merged = edges.sparkSession.createDataFrame([(-1, -1)], "tip long, id long")
    reached = graph.closure(above, tips.select(F.col("tip").cast("long").alias("tip"), "id").unionByName(merged)).select("tip", "id")
    common = reached.where("tip <> -1").join(reached.where("tip = -1 and id <> -1").select("id"), "id", "left_semi")
    lower = common.join(edges, F.col("id") == F.col("child")).select("tip", F.col("parent").alias("id"))
    best = common.join(lower, ["tip", "id"], "left_anti").groupBy("tip").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return best.where("n = 1").select("tip", "id").join(past.select("id"), "id", "left_semi").select("tip", "id")


def branch_flags(edges: DataFrame, reached: DataFrame, tips: list[int]) -> DataFrame:
    """(id, flags): a sign for each of up to 63 tips that reach a commit; of commits that all reach only the best ones."""
    rows = reached.where(F.col("tip").isin(tips))
    held = rows.groupBy("id").agg(*(F.max(F.col("tip") == t).alias(f"t{t}") for t in tips))
    all_ = held.where(" and ".join(f"t{t}" for t in tips)).select("id")
    lower = edges.join(all_, F.col("child") == F.col("id")).select(F.col("parent").alias("id"))
    return held.join(lower, "id", "left_anti").select("id", F.concat(*(F.when(F.col(f"t{t}"), "+").otherwise(" ") for t in tips)).alias("flags"))


def rewritten_parents(edges: DataFrame, kept: DataFrame, first_parent: bool = True) -> DataFrame:
    """(child, parent): for each kept commit (id) the nearest kept ancestors; commits between them are left out.

    With all parents, a commit's walk holds the whole dropped history up to the next kept ones.
    """
    used = edges.where("ord = 0") if first_parent else edges
    start = used.join(kept, F.col("child") == F.col("id"), "left_semi").select(F.col("child").alias("tip"), F.col("parent").alias("id"))
    dropped = used.join(kept, F.col("child") == F.col("id"), "left_anti")
    return graph.closure(dropped, start).join(kept, "id", "left_semi").select(F.col("tip").alias("child"), F.col("id").alias("parent")).distinct()


def peeled(tags: DataFrame) -> DataFrame:
    """(id, target): what each tag (id, target) stands for after all tags that point at tags; null for tags that lead into a cycle.

    Pointers are doubled each round, so a chain of n tags takes log2(n) rounds of one equi-join.
    """
    now = graph._checkpointed(tags.select(F.col("id"), F.col("target").alias("at")))
    for _ in range(max(1, now.count()).bit_length() + 1):
        step = now.select(F.col("id").alias("at"), F.col("at").alias("after"))
        joined = now.join(step, "at", "left")
        if joined.where("after is not null").isEmpty():
            return now.select("id", F.col("at").alias("target"))
        now = graph._checkpointed(joined.select("id", F.coalesce("after", "at").alias("at")))
    ring = now.select(F.col("id").alias("at"), F.lit(True).alias("ring"))
    return now.join(ring, "at", "left").select("id", F.when(F.col("ring").isNull(), F.col("at")).alias("target"))
