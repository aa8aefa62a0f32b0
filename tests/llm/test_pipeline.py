"""The pipeline against a plain version of its stages, given the language model's decisions."""

import random

import pytest

from annalist.llm import decontaminate, language_id

from . import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    rows = [(r.doc_id, r.text) for r in language_id.predict(docs, model).where("lang_pred <> 'und' and score >= 0.3").collect()]
    group = brute.components(rows, 5, 80)
    rows = sorted((i, t) for i, t in rows if group[i][1] == i)
    cut = {i: (gone, kept) for i, _, gone, kept in brute.cut(rows, corpus_pipeline.PASSAGE_WORDS)}
    rows = [(i, cut[i][1] if cut[i][0] else t) for i, t in rows]
    rows = [(i, t) for i, t in rows if t]
    matcher = decontaminate.Matcher([(r.item_id, decontaminate.normal(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = {i: t for i, t in rows if not list(matcher.matches(t.encode()))}
    got = {r.doc_id: r.text for r in out}
    assert got.items() <= clean.items()
    sizes = {i: len(brute.WORD.findall(t)) for i, t in clean.items()}
    assert sum(r.taken for r in out) == pytest.approx(sum(sizes.values()), rel=0.1)
    assert all(r["size"] == sizes[r.doc_id] and 0 < r.taken <= 3 * r["size"] for r in out)


def test_one_row_of_a_group_stays(spark):
    rng = random.Random(4)
    make = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    a, b, c, d, e = (make() for _ in range(5))
    near = [*c[:-1], "changed"]
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (4, c), (None, c), (None, near), (None, d), (None, d), (None, [*d[:-1], "x"]), (5, e), (5, e), (6, ["LONE", *e[1:]])]
    docs = spark.createDataFrame([(i, " ".join(w), "s") for i, w in rows] + [(1, "  ".join(a).upper(), "s")], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text.lower().split()) for r in got.collect()]
    kept = [next(k for k, w in zip("abcde", (a, b, c, d, e), strict=True) if w[:30] == t[:30]) for _, t in found]
    assert sorted(kept) == list("abcde"), found
    ids = dict(zip(kept, (i for i, _ in found), strict=True))
    assert ids["c"] == 4 and ids["d"] is None and ids["e"] == 5
    assert (ids["a"], ids["b"]) in ((1, 3), (2, 1))  # id 1 is the key of one of its two texts
    unique = docs.where("doc_id in (2, 3, 4)")
    assert sorted(corpus_pipeline.drop_near_duplicates(spark, unique, SF).collect()) == sorted(unique.collect())
