"""The hand-made graph with known answers, and text diffs against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.functions.text_diff import myers
from annalist.operators import graph
from annalist.plans import projection as P

NAMES = dict(a=1, b=2, c=3, d=4, e=5, f=6, x=7)


@pytest.fixture
def edges(spark):
    pairs = [("b", "a", 0), ("d", "b", 0), ("f", "d", 0), ("c", "a", 0), ("e", "c", 0), ("f", "e", 1)]
    return spark.createDataFrame([(NAMES[c], NAMES[p], o) for c, p, o in pairs], "child long, parent long, ord int")


def tips(spark, *names):
    return spark.createDataFrame([(i + 1, NAMES[n]) for i, n in enumerate(names)], "tip long, id long")


def ids(df):
    return {r.id for r in df.collect()}


def named(text):
    return {NAMES[c] for c in text}


@pytest.mark.parametrize("limit", [graph.TASK_EDGES, 0])
def test_both_closures_agree(spark, edges, limit):
    got = {(r.tip, r.id, r.depth) for r in graph.closure(edges, tips(spark, "f", "x"), task_edges=limit).collect()}
    assert got == {(1, 6, 0), (1, 4, 1), (1, 5, 1), (1, 2, 2), (1, 3, 2), (1, 1, 3), (2, 7, 0)}


def test_loop_over_filtered_edges(spark):
    """Rounds unite tables whose plans filter, as those of the projections do."""
    rows = [tuple(P.table(spark, "/root/testdata/sf0.001", n) for n in ("edges", "tips"))] * 2
    one, two = (sorted(map(tuple, graph.closure(e, t, task_edges=n).collect())) for (e, t), n in zip(rows, (graph.WALK_EDGES, 0), strict=True))
    assert len(one) > 100 and one == two


def test_ranges_and_bases(spark, edges):
    reached = graph.closure(edges, tips(spark, "d", "e", "f"))
    assert ids(graph.merge_bases(edges, reached, [1, 2])) == named("a")
    assert ids(graph.difference(reached, [3], [1])) == named("fec")
    assert graph.ahead_behind(reached, 1, 2).first().asDict() == {"ahead": 2, "behind": 2}
    assert ids(graph.boundary(edges, graph.difference(reached, [3], [1]))) == named("da")
    assert ids(graph.independent(edges, reached, tips(spark, "d", "e", "f"))) == named("f")


def test_first_parents(spark, edges):
    assert ids(graph.closure(edges, tips(spark, "f"), first_parent=True)) == named("fdba")


@pytest.mark.parametrize("limit", [graph.TASK_EDGES, 0])
def test_generations(spark, edges, limit):
    nodes = spark.createDataFrame([(i,) for i in NAMES.values()], "id long")
    got = {r.id: r.generation for r in graph.generations(edges, nodes, task_edges=limit).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4, 7: 1}


def test_bisect(spark, edges):
    got = {r.id: (r.weight, r.distance) for r in graph.bisect_weights(edges, spark.createDataFrame([(i,) for i in range(1, 7)], "id long")).collect()}
    assert got[4] == (3, 3) and got[6] == (6, 0) and got[1] == (1, 1)


def test_bisect_blocks_agree_with_walks(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i - d, d > 1) for i in range(2, 150) for d in (1, 7) if i > d and i % 50], "child long, parent long, ord boolean")
    nodes = spark.createDataFrame([(i,) for i in range(1, 150)], "id long")
    want = sorted(map(tuple, graph.bisect_weights(edges, nodes, task_edges=0).collect()))
    monkeypatch.setattr(graph, "BITS", 1)
    pairs = [(False, *r[:2]) for r in edges.orderBy("child").collect()] + [(True, i, i) for i in range(1, 200)]
    rows = graph.pa.record_batch([graph.pa.array([k for k, _, _ in pairs]), *(graph.pa.array([x.to_bytes(8, "little") for x in c]) for c in list(zip(*pairs, strict=True))[1:])], ["kind", "a", "z"])
    got = dict(zip(*(c.to_pylist() for c in next(graph._weights([rows])).columns), strict=True))
    assert {i: got[i] for i in range(1, 150)} == {i: w for i, w, _ in want} and got[199] == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_myers_is_shortest_and_right(a, b):
    x, y, kept = 0, 0, 0
    for op, n in myers(a, b):
        if op == "=":
            assert a[x : x + n] == b[y : y + n]
            kept += n
        x += n * (op != "+")
        y += n * (op != "-")
    assert (x, y) == (len(a), len(b))
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, z in enumerate(b):
            new.append(row[j] + 1 if c == z else max(row[j + 1], new[j]))
        row = new
    assert kept == row[-1]
