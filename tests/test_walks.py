import pytest

from annalist.operators import history, refs, trees
from annalist.plans import more

SF = "/root/testdata/sf0.001"


def test_peeled_follows_long_chains_and_drops_cycles(spark):
    rows = [(f"t{i}", f"t{i + 1}") for i in range(9)] + [("t9", "c1"), ("u", "c2"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("s", "r1"), ("self", "self"), ("n", None)]
    got = dict(history.peeled(spark.createDataFrame(rows, "id string, target string")).collect())
    assert got == {f"t{i}": "c1" for i in range(10)} | {"u": "c2", "r1": None, "r2": None, "r3": None, "s": None, "self": None, "n": None}
    assert history.peeled(spark.createDataFrame([], "id string, target string")).count() == 0


def test_fork_point_must_be_a_past_value(spark):
    #  1 - 2 - 3 - 4      branch, whose past values are 2 and 4
    #      |   ` - 6      leaves at 3, which never was a value of the branch
    #      ` - 5          leaves at 2
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 2, 0), (6, 3, 0)], "child long, parent long, ord int")
    tips = spark.createDataFrame([(1, 5), (2, 6), (3, 4)], "tip long, id long")
    past = spark.createDataFrame([(2,), (4,)], "id long")
    assert sorted(map(tuple, history.fork_points(edges, tips, past).collect())) == [(1, 2), (3, 4)]


def test_rewritten_parents_skip_dropped_commits(spark):
    edges = spark.createDataFrame([(5, 4, 0), (4, 3, 0), (3, 1, 0), (4, 2, 1), (2, 1, 0)], "child long, parent long, ord int")
    kept = spark.createDataFrame([(5,), (2,), (1,)], "id long")
    assert sorted(map(tuple, history.rewritten_parents(edges, kept).collect())) == [(2, 1), (5, 1)]
    assert sorted(map(tuple, history.rewritten_parents(edges, kept, first_parent=False).collect())) == [(2, 1), (5, 1), (5, 2)]


CASES = [  # index, head, tree, changed, action
    (None, None, "m", False, "update"), (None, "h", None, False, "remove"), (None, "h", "h", False, "keep"), (None, "h", "m", False, "fail"),
    ("i", None, None, True, "keep"), ("m", None, "m", True, "keep"), ("i", None, "m", False, "fail"),
    ("h", "h", None, False, "remove"), ("h", "h", None, True, "fail"), ("i", "h", None, False, "fail"),
    ("i", "h", "h", True, "keep"), ("h", "h", "h", True, "keep"), ("i", "h", "m", False, "fail"), ("m", "h", "m", True, "keep"),
    ("h", "h", "m", False, "update"), ("h", "h", "m", True, "fail"),
]


def test_unpack_two_way_case_by_case(spark):
    side = lambda k: spark.createDataFrame([(n, c[k], 33188) for n, c in enumerate(CASES) if c[k]], "path long, oid string, mode int")
    dirty = spark.createDataFrame([(n,) for n, c in enumerate(CASES) if c[3]], "path long")
    got = dict(trees.unpack_two_way(side(0), side(1), side(2), dirty).collect())
    assert got == {n: c[4] for n, c in enumerate(CASES)}


def test_resolved_paths(spark):
    files = spark.createDataFrame([(1, "a/b/c", "x"), (1, "a/b2", "y"), (2, "a", "z")], "commit_id long, path string, oid string")
    asked = spark.createDataFrame([(1, "a"), (1, "a/b"), (1, "a/b2"), (1, "b"), (2, "a"), (3, "a")], "commit_id long, path string")
    got = {(r.commit_id, r.path): (r.type, r.oid, r.entries) for r in trees.resolved(asked, files).collect()}
    assert got == {(1, "a"): ("tree", None, 2), (1, "a/b"): ("tree", None, 1), (1, "a/b2"): ("blob", "y", 1), (1, "b"): ("missing", None, 0), (2, "a"): ("blob", "z", 1), (3, "a"): ("missing", None, 0)}


@pytest.mark.parametrize("name", ["show_branch", "objects_edge", "simplified_by_decoration", "peeled_tags", "tree_paths", "unpack_one_way", "unpack_two_way", "path_history", "update_kinds", "killed_paths"])
def test_queries_find_something(spark, name):
    assert not more.QUERIES[name](spark, SF).isEmpty()


def test_upstreams_take_the_last_value_and_the_first_rule(spark):
    rows = [("remote.o.fetch", "+refs/heads/*:refs/remotes/o/*"), ("remote.o.fetch", "refs/heads/*:refs/remotes/late/*"), ("remote.p.fetch", "refs/heads/main:refs/p/main"), ("remote.p.push", "refs/heads/*:refs/q/*"),
            ("remote.bad.fetch", "refs/heads/main"), ("branch.a.b.remote", "p"), ("branch.a.b.remote", "o"), ("branch.a.b.merge", "refs/heads/x.y/z"), ("branch.m.remote", "p"), ("branch.m.merge", "refs/heads/main"),
            ("branch.n.remote", "p"), ("branch.n.merge", "refs/heads/other"), ("branch.l.remote", "."), ("branch.l.merge", "refs/heads/main"), ("branch.bad.remote", "bad"), ("branch.bad.merge", "refs/heads/main"), ("branch.half.remote", "o")]
    config = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, value string, ord int")
    assert dict(refs.upstreams(config).collect()) == {"a.b": "refs/remotes/o/x.y/z", "m": "refs/p/main", "n": None, "l": "refs/heads/main", "bad": None}


def test_killed_paths(spark):
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    got = trees.killed(paths("a/b", "c", "d/e/f", "g", "ab"), paths("a", "c/d/e", "d/x", "g")).collect()
    assert sorted(r.path for r in got) == ["a/b", "c"]


def test_changed_from_parent(spark):
    files = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "x", 1), (3, "a", "y", 1), (5, "b", "x", 1)], "commit_id long, path string, oid string, mode int")
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 4, 0), (5, 1, 1), (6, 5, 0)], "child long, parent long, ord int")
    commits = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5, 6, 7]], "id long")
    assert sorted(r.id for r in trees.changed_from_parent(files, edges, commits).collect()) == [1, 3, 4, 5, 6]
