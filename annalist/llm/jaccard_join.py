"""Exact n-gram Jaccard join as a metric-space join.

The Jaccard distance ``d = 1 - |x & y| / |x | y|`` is a metric; two documents link
when ``d <= r`` (``percent`` = 100 (1 - r)).  Equal sets collapse to one class first,
and classes are the points that are joined.

*Level 0.*  Between unrelated texts every distance is close to 1, so whole documents
would put every document into the window of every region.  The first pivots are
therefore singleton sets: ``d(x, {s}) = 1 - 1/|x|`` if x holds the shingle s and 1
otherwise, so the regions nearest to x are those of its own shingles, ties broken by
one global order.  The boundary window of radius r follows from the sizes: partners
share at least one of the first ``|x| - ceil((1 - r)|x|) + 1`` shingles, so x goes to
exactly these regions.  (This is the prefix filter.)  In the order, a fixed part of
all shingles (by hash) comes first, rare ones before frequent ones, as counted over
all classes (``counted_keys``); then the others by hash.  Most documents' windows hold
only shingles of their own, so they are done without a comparison.

*Level 1.*  Each region takes its smallest class as pivot; every member whose size
allows it is compared with the pivot, each pair once whatever number of regions it
shares.  Linked members are joined through the pivot, and a region whose members are
all connected is finished.

*Voronoi levels.*  A region that is too large for a task is dealt into chunks, and
``PIVOTS`` of its members are pivots of all chunks.  Each member goes to the region of
its nearest pivot p (its home) and, by the triangle inequality, to those of all pivots
within ``d(x, p) + 2 r``: if x and y link, y is in x's home region.  These regions
recurse.  A member whose window holds more than half of the pivots (it is far from
all) isn't replicated: it meets all members of the region in blocks of bounded size,
as do members of regions that do not shrink.

*Sizes.*  ``1 - min/max`` of the sizes bounds the distance from below, so regions that
are not finished are split into overlapping bands of sizes, and of regions with the
same members one is enough.

*Families.*  Regions that share members, such as those of near copies with many
common shingles, are joined together where all of them fit a task.

*Ends.*  A region that fits a task (bounded in members and in shingles) is joined
exactly in it: every pair that sizes allow and that isn't connected yet is counted.

Only links that connect two components leave a task, at most its members less one, so
no pairs inside a group of copies are made, and components lose no link.

Defined results: null and empty texts, and texts without words, have the empty
set, size 0 and link with nothing (``component_id`` is their own id); texts of fewer
words than a shingle have one shingle, the whole sequence; rows that repeat an id are
judged row by row; a row with a null id links through its text, and its component is
the smallest id reachable, null if there is none; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .shared_keys import bucket_count, counted_keys, runs
from .storage import forget, only_near, scratch, stored

#: Part of the shingles that are counted, as a multiple of the part that a partner may lack.
COUNTED = 1.75
#: Members, and shingles of all of them (8 bytes each), of a region that is finished in one task; of a chunk of a larger one likewise.
TASK_MEMBERS, TASK_SHINGLES = 8192, 1 << 20
#: Pivots of a Voronoi level, and of them the part that a member's window may hold.
PIVOTS, WIDE = 32, 0.5
#: A region with more than this part of its parent's members does not shrink.
SHRINKS = 0.75
#: Rows of Arrow batches that hold sets.
SET_ROWS = 500


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower-cased A-Z)."""
    buf = tokens.Buffer(texts, lower=True)
    h = buf.hashes()
    g = tokens.grams(h, words)
    out = []
    for i in range(len(texts)):
        a, b = int(buf.first[i]), int(buf.first[i + 1])
        if b - a >= words:
            out.append(np.unique(g[a : b - words + 1]))
        else:  # a gram of another length has other weights: never equal to a full shingle's
            out.append(tokens.mix(tokens.grams(h[a:b], b - a) + np.uint64(b - a)) if b > a else h[:0])
    return out


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets_of(batches, words):
    for batch in tokens.pieces(batches):
        ids = batch.column(0).to_pylist()
        for at, held in tokens.slices(tokens.as_bytes(batch.column(1))):
            yield ids[at : at + len(held)], shingle_sets(held, words)


def _limit(percent: int) -> int:
    """The first 48-bit shingle that is not counted."""
    return int(min(1.0, COUNTED * (100 - percent) / 100 + 0.01) * (1 << 48))


def _signatures(words: int, percent: int):
    """Size, digest and first 48-bit shingles of each document's set: those that are counted, and enough for a prefix."""
    limit = np.uint64(_limit(percent))

    def run(batches):
        for ids, sets in _sets_of(batches, words):
            first = []
            for x in sets:  # sorted, so the counted ones come first
                x = x >> np.uint64(16)
                first.append(np.ascontiguousarray(x[: max(int(np.searchsorted(x, limit)), _prefix(len(x), percent))].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
            one, two = zip(*map(_digest, sets), strict=True)
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "one": _long(one), "two": _long(two), "first": pa.array(first, pa.binary())})

    return run


def _digest(x: np.ndarray) -> tuple[int, int]:
    if not len(x):
        return 0, 0
    return int(np.bitwise_xor.reduce(tokens.mix(x))), int(np.add.reduce(tokens.mix(x ^ np.uint64(0x5851F42D4C957F2D))))


def _long(x) -> pa.Array:
    return pa.array(tokens.signed(np.array(x, np.uint64)))


def _packed_sets(words: int):
    """Digest and set of each document."""

    def run(batches):
        for _, sets in _sets_of(batches, words):
            sets = [x for x in sets if len(x)]
            if sets:
                one, two = zip(*map(_digest, sets), strict=True)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.record_batch({"one": _long(one), "two": _long(two), "held": pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.signed(np.concatenate(sets))))})

    return run


class Overlaps:
    """Intersection sizes of sets that are laid end to end, by inverted lists."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        values, at = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        self.at = at.astype(np.int32)
        order = np.argsort(self.at, kind="stable")
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), self.size)[order]
        self.first = np.searchsorted(self.at[order], np.arange(len(values) + 1))

    def __call__(self, q: int) -> np.ndarray:
        """Sizes of the intersections of set ``q`` with every set."""
        own = self.at[self.ends[q] : self.ends[q + 1]]
        low, many = self.first[own], self.first[own + 1] - self.first[own]
        shift = np.concatenate([[0], np.cumsum(many)[:-1]])
        rows = np.repeat(low - shift, many) + np.arange(int(many.sum()))
        return np.bincount(self.owner[rows], minlength=self.n)

    def distance(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(intersections, unions) of set ``q`` with every set."""
        same = self(q)
        return same, self.size + self.size[q] - same


class Merge:
    """Links between the labels of a task's members; only those that connect two labels are kept."""

    def __init__(self, labels):
        _, self.label = np.unique(np.asarray(labels), return_inverse=True)
        self.links: list[tuple[int, int]] = []

    def add(self, q: int, others: np.ndarray) -> None:
        for x in others.tolist():
            if self.label[x] != self.label[q]:
                self.links.append((x, q))
                self.label[self.label == self.label[x]] = self.label[q]


def settle(sets: list[np.ndarray], labels, percent: int, open_=None) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``sets`` beyond ``labels``, at most their number less one.

    Every pair of other labels is counted, if ``open_`` is given every pair with at least one open
    member.  Members of the most frequent label come last, so a group of copies costs its exceptions.
    """
    n = len(sets)
    if not n:
        return []
    shared, merge = Overlaps(sets), Merge(labels)
    size, left = shared.size, np.ones(n, bool)
    if open_ is None:
        todo = np.ones(n, bool)
    else:
        todo = np.asarray(open_, bool).copy()
    while True:
        rest = np.flatnonzero(left)
        counts = np.bincount(merge.label[rest], minlength=1)
        top = int(np.argmax(counts))
        if counts[top] == len(rest):
            return merge.links
        asked = rest[todo[rest]]
        if not len(asked):
            return merge.links
        outside = asked[merge.label[asked] != top] if open_ is None else asked
        for q in (outside if len(outside) else asked)[:64].tolist():
            near = left & (merge.label != merge.label[q]) & (100 * np.minimum(size, size[q]) >= percent * np.maximum(size, size[q]))
            left[q] = False
            if near.any():
                same, union = shared.distance(q)
                merge.add(q, np.flatnonzero(near & (100 * same >= percent * union)))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _sets(table: pa.Table) -> list[np.ndarray]:
    out = []
    for chunk in table.column("held").chunks:
        values, ends = chunk.values.to_numpy(zero_copy_only=False).view(np.uint64), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def _link_rows(x: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array([i for i, _ in found], np.int64), np.array([j for _, j in found], np.int64)
    return pa.record_batch({"a": pa.array(x[a], pa.int64()), "b": pa.array(x[b], pa.int64())})


def _finish(percent: int, blocks: bool = False):
    """Links of regions that come as runs of rows (s, x, root, open, held)."""

    def run(batches):
        for table in runs(batches, "s"):
            x, open_ = _column(table, "x"), np.asarray(_column(table, "open"), bool)
            if blocks:  # a member may be there as an open one and as another
                order = np.lexsort((~open_, x))
                order = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])]
                table = table.take(pa.array(order)).combine_chunks()
                x, open_ = _column(table, "x"), np.asarray(_column(table, "open"), bool)
            found = settle(_sets(table), _column(table, "root"), percent, open_ if blocks else None)
            if found:
                yield _link_rows(x, found)

    return run


def _voronoi(percent: int):
    """Rows (kind, s, x, y) of chunks that come as runs of rows (g, s, x, root, pivot, held): links (0), places in
    pivots' regions (1; y: the pivot), and members whose window is wide (2)."""
    r = 1 - percent / 100

    def run(batches):
        for table in runs(batches, "g"):
            x, s, pivot = _column(table, "x"), int(_column(table, "s")[0]), np.asarray(_column(table, "pivot"), bool)
            sets = _sets(table)
            shared, merge = Overlaps(sets), Merge(_column(table, "root"))
            at, rows = np.flatnonzero(pivot), np.flatnonzero(~pivot)
            away = np.empty((len(at), len(rows)))
            for i, q in enumerate(at.tolist()):
                same, union = shared.distance(q)
                merge.add(q, np.flatnonzero(100 * same >= percent * union))
                away[i] = 1 - same[rows] / union[rows]
            window = away <= away.min(axis=0) + 2 * r + 1e-9
            wide = window.sum(axis=0) > max(1, WIDE * len(at))
            kind = [np.zeros(len(merge.links), np.int64)]
            left, right = [x[np.array([i for i, _ in merge.links], np.int64)]], [x[np.array([j for _, j in merge.links], np.int64)]]
            p, m = np.nonzero(window & ~wide)
            kind.append(np.ones(len(p), np.int64))
            left.append(x[rows[m]])
            right.append(x[at[p]])
            w = np.flatnonzero(wide)
            kind.append(np.full(len(w), 2))
            left.append(x[rows[w]])
            right.append(x[rows[w]])
            k = np.concatenate(kind)
            yield pa.record_batch({"kind": pa.array(k, pa.int64()), "s": pa.array(np.full(len(k), s), pa.int64()), "x": pa.array(np.concatenate(left), pa.int64()), "y": pa.array(np.concatenate(right), pa.int64())})

    return run


def _sorted_runs(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def _fetch(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(x, held) of the classes of ``wanted`` (x, rep, one, two, n): the set of one of their rows."""
    ids = wanted.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    near = only_near(rows.where("doc_id is not null"), ids).join(ids, "doc_id", "left_semi").select("doc_id", "text")
    if not wanted.where("rep is null").isEmpty():
        near = near.unionByName(rows.where("doc_id is null").select("doc_id", "text"))
    sets = near.mapInArrow(_packed_sets(words), "one long, two long, held array<long>")
    return sets.join(wanted.select("x", "one", "two", "n"), ["one", "two"]).where(F.size("held") == F.col("n")).dropDuplicates(["one", "two", "x"]).select("x", "held")


def _joined(links: list[DataFrame]) -> DataFrame:
    total = links[0]
    for more in links[1:]:
        total = total.unionByName(more)
    return components(total)


def _once(rows: DataFrame) -> DataFrame:
    """One region of those that have the same members (by two 64-bit sums over them)."""
    marks = rows.groupBy("s").agg(F.bit_xor(F.xxhash64("x", F.lit(1))).alias("one"), F.sum(F.shiftrightunsigned(F.xxhash64("x", F.lit(2)), 8).cast("decimal(38,0)")).alias("two"), F.count(F.lit(1)).alias("k"))
    one = marks.groupBy("one", "two", "k").agg(F.min("s").alias("s")).select("s")
    return stored(rows.join(one, "s", "left_semi"), "once")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (s, x, n, parent) of regions that hold several components, with the columns root and m."""
    rows = members.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    rows = stored(rows, "labelled")
    several = rows.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high")
    return rows.join(several.select("s", "m"), "s")


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """Regions split by bands of sizes: ``1 - min/max`` bounds the distance from below, so members that link are in one band or in neighbouring ones."""
    width = max(math.log(100 / percent) * (1 + 1e-9), 1e-6)  # a little wider than r, whatever the rounding
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("long")
    return rows.withColumn("s", F.explode(F.array(F.xxhash64("s", band), F.xxhash64("s", band + 1)))).dropDuplicates(["s", "x"])


def _families(rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Joins regions that share members in one task, so that a set moves once.  Returns the rows of regions whose family is too large, and links."""
    hubs = rows.groupBy("s").agg(F.min("x").alias("hub"))
    tied = rows.join(hubs, "s").where("x <> hub").select(F.col("x").alias("a"), F.col("hub").alias("b"))
    ties = components(tied).select(F.col("node").alias("x"), F.col("root").alias("family"))
    named = stored(rows.join(ties, "x", "left").withColumn("family", F.coalesce("family", "x")), "families")
    own = named.select("family", "x", "n", "root").distinct()
    fits = own.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w")).where((F.col("k") <= TASK_MEMBERS) & (F.col("w") <= TASK_SHINGLES)).select("family")
    fits = stored(fits, "fits")
    tasks = own.join(fits, "family", "left_semi").join(sets, "x").select(F.col("family").alias("s"), "x", "root", F.lit(True).alias("open"), "held")
    links = stored(_sorted_runs(tasks, "s").mapInArrow(_finish(percent), "a long, b long"), "links", SET_ROWS)
    return stored(named.join(fits, "family", "left_anti").drop("family"), "rest"), links


def _large_regions(rows: DataFrame, sets: DataFrame, percent: int, links: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A Voronoi level over large regions (s, x, n, root, m, weight); adds links.  Returns places (s, x, parent) and members of wide windows (s, x)."""
    order = F.xxhash64("x", F.lit(11))
    from pyspark.sql import Window

    rows = rows.withColumns({"parts": F.ceil(F.greatest(F.col("m") / TASK_MEMBERS, F.col("weight") / TASK_SHINGLES)).cast("int"), "many": F.greatest(F.lit(2), F.least(F.lit(PIVOTS), F.floor(F.lit(TASK_SHINGLES) / 2 * F.col("m") / F.col("weight")))).cast("int")})
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy(order, "x"))).where(F.col("i") <= PIVOTS).where(F.col("i") <= F.col("many"))
    pivots = ranked.select("s", "x", "root", F.lit(True).alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = rows.select("s", "x", "root", F.lit(False).alias("pivot"), F.pmod(F.xxhash64("x", F.lit(5)), F.col("parts").cast("long")).cast("int").alias("part"))
    both = own.unionByName(pivots).join(sets, "x").select(F.xxhash64("s", "part").alias("g"), "s", "x", "root", "pivot", "held")
    found = stored(_sorted_runs(both, "g").mapInArrow(_voronoi(percent), "kind long, s long, x long, y long"), "voronoi", SET_ROWS)
    links.append(found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
    size = rows.select("s", F.col("m").alias("parent")).distinct()
    placed = found.where("kind = 1").join(size, "s").select(F.xxhash64("s", "y").alias("s"), "x", "parent").dropDuplicates(["s", "x"])
    return placed, found.where("kind = 2").select("s", "x").distinct()


def _blocks(rows: DataFrame, wide: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the members ``wide`` (s, x) with all members of their regions (s, x, n, root), block against block."""
    held = rows.join(wide.withColumn("open", F.lit(True)), ["s", "x"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    half, most = max(1, TASK_MEMBERS // 2), max(1, TASK_SHINGLES // 2)
    sizes = held.groupBy("s").agg(*(F.ceil(F.greatest(F.sum(F.when(c, 1)) / half, F.sum(F.when(c, F.col("n"))) / most)).cast("int").alias(name) for c, name in ((F.col("open"), "bw"), (F.lit(True), "ba")))).where("bw is not null")
    dealt = stored(held.join(sizes, "s"), "blocks")
    at = lambda n: F.pmod(F.xxhash64("x", F.lit(3)), F.col(n).cast("long")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = dealt.where("open").select("s", "x", "root", "open", at("bw").alias("i"), upto("ba").alias("j"))
    told = dealt.select("s", "x", "root", F.lit(False).alias("open"), at("ba").alias("j"), upto("bw").alias("i"))
    both = asks.unionByName(told).join(sets, "x").select(F.xxhash64("s", "i", "j").alias("s"), "x", "root", "open", "held")
    return stored(_sorted_runs(both, "s").mapInArrow(_finish(percent, True), "a long, b long"), "links", SET_ROWS)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_class): one row per row of ``docs``; ``n_class`` counts the rows with an equal set.

    Documents link when ``100 * |x & y| >= percent * |x | y|`` over distinct ``words``-word shingles.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, words, percent))


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = stored(rows.mapInArrow(_signatures(words, percent), "doc_id long, n long, one long, two long, first binary"), "signatures")
    classes = base.where("n > 0").groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_class"), F.first("first").alias("first"))
    classes = stored(classes.withColumn("x", F.monotonically_increasing_id()), "classes")
    found = counted_keys(classes.select("x", "first"), "first", _limit(percent), bucket_count(docs))
    # shingles of this class alone come first in the order, and no other class has them
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1
    left = (prefix - (F.octet_length("first") / 6).cast("long") + F.size("codes")).cast("int")
    within = found.withColumnRenamed("id", "x").join(classes.select("x", "n", "first"), "x").withColumn("left", left).where("left > 0")
    last = F.get("codes", F.least(F.col("left"), F.size("codes")) - 1)
    cells = within.withColumn("codes", F.array_distinct(F.filter("codes", lambda c: c <= last)))
    members = stored(cells.select(F.explode("codes").alias("s"), "x", "n"), "members")
    busy = members.groupBy("s").agg(F.min(F.struct("x", "n")).alias("q"), F.max("x").alias("high")).where("q.x < high").select("s", F.col("q.x").alias("q"), F.col("q.n").alias("qn"))
    state = stored(members.join(busy, "s"), "state")
    forget(members)
    wanted = classes.drop("first", "n_class").join(state.select("x").distinct(), "x", "left_semi")
    sets = stored(_fetch(rows, stored(wanted, "wanted"), words), "sets", SET_ROWS)

    # level 1: each member against the pivots of its regions, each pair once
    fits = F.least("n", "qn") * 100 >= F.greatest("n", "qn") * percent
    pairs = state.where("x <> q").where(fits).select("x", "q", "n", "qn").distinct()
    both = pairs.join(sets, "x").join(sets.select(F.col("x").alias("q"), F.col("held").alias("held_q")), "q")
    same = F.size(F.array_intersect("held", "held_q"))
    links = [stored(both.withColumn("same", same).where(F.col("same") * 100 >= (F.col("n") + F.col("qn") - F.col("same")) * percent).select(F.col("x").alias("a"), F.col("q").alias("b")), "links")]

    # what is joined through one or two pivots needs no more comparisons
    schema, first = "a long, b long", links[0].groupBy("a").agg(F.min("b").alias("b"))
    second = first.select(F.col("a").alias("b"), F.col("b").alias("c"))
    roots = first.join(second, "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("root"))
    # two members have met as member and pivot
    regions = _banded(_labelled(state.select("s", "x", "n"), roots).where("m > 2").select("s", "x", "n"), percent)
    regions = regions.withColumn("parent", F.lit(None).cast("long"))
    while True:
        rest = _once(_labelled(regions, roots))
        if rest.isEmpty():
            break
        sizes = rest.groupBy("s").agg(F.sum("n").alias("weight"))
        rest = stored(rest.join(sizes, "s"), "regions")
        fits_task = (F.col("m") <= TASK_MEMBERS) & (F.col("weight") <= TASK_SHINGLES)
        rest, more = _families(rest, sets, percent)
        links.append(more)
        if rest.isEmpty():
            break
        small = rest.where(fits_task)
        tasks = small.join(sets, "x").select("s", "x", "root", F.lit(True).alias("open"), "held")
        links.append(stored(_sorted_runs(tasks, "s").mapInArrow(_finish(percent), schema), "links", SET_ROWS))
        large = rest.where(~fits_task)
        if large.isEmpty():
            break
        stuck = large.where(F.col("m") > SHRINKS * F.col("parent"))
        top = stuck.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("top"))
        wide = stuck.join(top, "s").where("root <> top").select("s", "x")
        go = large.where("parent is null or m <= parent * %r" % SHRINKS)
        regions, more = _large_regions(go, sets, percent, links)
        links.append(_blocks(large.select("s", "x", "n", "root"), wide.unionByName(more), sets, percent))
        roots = _joined(links)
        regions = stored(regions.join(classes.select("x", "n"), "x").select("s", "x", "n", "parent"), "places")

    roots = _joined(links)
    # a class's component has the smallest id of its classes
    labelled = stored(classes.drop("first").join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x")), "labels")
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    whole = labelled.join(lowest, "root").select("one", "two", "n", "n_class", "component_id", F.lit(True).alias("known"))
    out = base.select("doc_id", "n", "one", "two").join(whole, ["one", "two", "n"], "left")
    return stored(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class")), "components")
