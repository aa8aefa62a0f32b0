"""The Jaccard join against brute force: levels, repeated and null ids, odd rows."""

import random

import numpy as np
import pytest

from annalist.llm import components, jaccard_join

from . import brute


def by_row(rows, words, percent):
    """[(size, component)] of rows (id, text), judged row by row."""
    found = brute.components([(k, t) for k, (_, t) in enumerate(rows)], words, percent)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            root = found[k][1]
            low[root] = min(low.get(root, i), i)
    return [(i, n, low.get(root) if n else i) for (i, _), (n, root) in zip(rows, found.values(), strict=True)]


def joined(spark, rows, words, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, words, percent).collect()), key=str)


def family(rng, size, edits, length=40):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = f"e{rng.randrange(50)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("limits", [(2048, 1 << 20), (8, 400)])
@pytest.mark.parametrize("edits", [4])
def test_levels(spark, monkeypatch, limits, edits):
    """Chains near the threshold, far members of one region, copies: in one task, by pivots and in blocks."""
    monkeypatch.setattr(jaccard_join, "TASK_MEMBERS", limits[0])
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", limits[1])
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    rng = random.Random(edits)
    texts = [t for size in (30, 9, 3) for t in family(rng, size, edits)] + [f"a b c x{i} y{i % 7} z{i % 3}" for i in range(20)] + ["a b c d e"] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert joined(spark, rows, 2, 70) == sorted(by_row(rows, 2, 70), key=str)


def test_repeated_and_null_ids(spark):
    rng = random.Random(9)
    one, two, three = family(rng, 6, 1), family(rng, 6, 1), family(rng, 3, 0)
    rows = [(1, one[0]), (1, two[0]), (1, one[0]), (None, one[1]), (2, two[1]), (None, three[0]), (None, three[1]), (3, None), (None, None), (4, ""), (4, " \t"), (5, "short"), (6, "SHORT"), (7, "x y"), (None, two[2])]
    assert joined(spark, rows, 3, 80) == sorted(by_row(rows, 3, 80), key=str)


def test_odd_tables(spark):
    kind = "doc_id long, text string, x long, s string, n long, one long, cells string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], kind), 3, 90).collect() == []
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 1, "s", 1, 1, "c"), (2, long + " end", 1, "s", 1, 1, "c"), (3, "no", 1, None, None, None, None)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, kind), 3, 90).select("doc_id", "component_id").collect())
    assert got == [(1, 1), (2, 1), (3, 3)]


def test_links_of_a_task_span_and_no_more():
    rng = np.random.default_rng(1)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(100, 11, replace=False)), rng.integers(1000, 10**6, 11).astype(np.uint64)])) for _ in range(800)]
    for percent in (60, 79):
        assert len(jaccard_join.settle(sets, range(800), percent)) <= 799
    assert jaccard_join.settle(sets, [5] * 800, 60) == []


def test_components_of_few_edges_cost_few_jobs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(500)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    spark.sparkContext.setJobGroup("few", "components in one task")
    try:
        one = {r.node: r.root for r in components.components(table).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8  # rounds of stars: over 20
    assert one == {r.node: r.root for r in components.components(table, task_edges=0).collect()}
    assert one[400] == 0 and 0 not in one and one[1099] == 1000
