"""Catalog queries over whole tables, on hand-made rows and by their properties."""

import shlex

from pyspark.sql import functions as F

from annalist.functions import messages
from annalist.operators import graph
from annalist.plans import catalog

SF = "/root/testdata/sf0.001"


def run(spark, name, sf_dir=SF):
    return catalog.QUERIES[name](spark, str(sf_dir)).collect()


def test_shell_quote(spark, tmp_path):
    texts = ["it's " * 100 + "\\ \"$x\" `y` !\n'", "'", "", None, "x" * 79 + "''y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: shlex.split(r.quoted) for r in run(spark, "shell_quote", tmp_path)}
    assert got == {i: [t or ""] for i, t in enumerate(texts)}


def test_shortlog_numbered(spark):
    authors = [r.author for r in catalog.P.table(spark, SF, "commits").select("author").collect()]
    want = sorted(((-authors.count(a), a) for a in set(authors)))
    assert len(want) > 20
    assert sorted((r["rank"], -r.n, r.author) for r in run(spark, "shortlog_numbered")) == [(i + 1, n, a) for i, (n, a) in enumerate(want)]


def test_refs_sorted(spark):
    priority = {r.id: r.priority for r in catalog.P.table(spark, SF, "commits").select("id", "priority").collect()}
    refs = sorted(((r.name, priority[r.id]) for r in catalog.P.table(spark, SF, "refs").collect()), reverse=True)
    want = sorted(refs, key=lambda r: r[1])  # stable: names of a priority stay in descending order
    assert len(want) > 30
    assert [(r.name, r.priority) for r in sorted(run(spark, "refs_sorted"), key=lambda r: r["rank"])] == want


def test_reflog_as_of(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-15 12:00:00"), (3, 7, "2024-01-15 12:00:01"), (4, 8, "2024-01-20 00:00:00"), (6, 9, "2024-01-02 00:00:00"), (5, 9, "2024-01-02 00:00:00")]
    spark.createDataFrame([(*r, "click") for r in rows], "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    assert {(r.ref, r.id, r.n) for r in run(spark, "reflog_as_of", tmp_path)} == {(7, 2, 2), (8, None, 0), (9, 6, 2)}


def test_cherry_marks(spark, tmp_path):
    rows = [(0, "a b"), (1, "ab"), (2, "c"), (4, "c"), (3, "d"), (5, "a  b"), (6, None), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.side + r.mark for r in run(spark, "cherry_marks", tmp_path)}
    assert got == {0: "<=", 1: ">=", 2: "<+", 4: "<+", 3: ">+", 5: ">=", 6: "<+", 7: ">+"}


def test_exact_rename_uses_a_source_once(spark, tmp_path):
    rows = [(3, "a"), (10, "a"), (1, "a"), (8, "a"), (15, "a"), (17, "b"), (4, "a")]  # 7 k + 3 goes, 7 k + 1 is new
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.src, r.dst) for r in run(spark, "exact_rename", tmp_path)) == [(3, 1), (10, 8)]


def test_merge_bases_with_a_merge_to_be(spark):
    # 1 - 2 - 3 - 4 and 2 - 5, 3 - 6: of 4 and a merge of 5 and 6 the best is 3
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 2, 0), (6, 3, 0)], "child long, parent long, ord int")
    reached = graph.closure(edges, spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "tip long, id long"))
    assert [r.id for r in graph.merge_bases_with(edges, reached, 1, [2, 3]).collect()] == [3]


def test_trailing_blanks_go_at_every_line(spark):
    texts = ["a \t\n  b\r\n \n", "  ", "", None, "x" + " " * 50_000 + "y "]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", messages.without_trailing_blanks("t").alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: None if t is None else "\n".join(x.rstrip(" \t") for x in t.split("\n")) for i, t in enumerate(texts)}
