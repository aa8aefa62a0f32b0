"""Columns of other names' owners, odd rows and empty tables, through operators and stages."""

import pytest

from annalist.llm import language_id, mixing, substring_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"

#: Names that operators use inside.
NAMES = ["_id", "_th", "_spans", "spans", "kept", "before", "budget", "whole", "_edge", "_s", "_n", "_sum", "_key", "_bin", "row", "x", "s", "n", "b", "raw", "score", "lang_pred", "n_words", "n_removed", "is_contaminated"]


@pytest.fixture(scope="module")
def odd(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 4
    rows = [(1, words, "en", "s1"), (2, words, "en", None), (2, words + "end", "de", "s1"), (None, words, None, "s2"), (3, None, "en", "s2"), (4, "", "en", ""), (5, " \t ", None, ""), (6, "short one", "en", "s1"), (7, "plain " * 1_000_000, "en", "s3"), (7, "plain " * 1_000_000, "en", "s3")]
    return spark.createDataFrame([(*r, len(r[1] or ""), *[f"{n}!" for n in NAMES]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_mixing_keeps_other_columns(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(r[n] == f"{n}!" for r in got for n in NAMES)
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_substring_dedup_keeps_other_columns(odd):
    got = substring_dedup.substring_dedup(odd.where("doc_id is null or doc_id < 7"), 13).collect()
    assert len(got) == 8
    assert all(r[n] == f"{n}!" for r in got for n in NAMES if n not in ("spans", "n_words", "n_removed"))
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("2", 80), ("2", 80), ("3", 0), ("4", 0), ("5", 0), ("6", 0), ("None", 0)]


def test_stages_keep_other_columns(spark, odd):
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"))
    assert language_id.predict(corpus_pipeline._packed(odd), model).count() == odd.count()
    for stage in (corpus_pipeline.cut_repeated_passages, corpus_pipeline.drop_benchmark_leaks):
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns
        rows = got.collect()
        assert rows and all(r[n] == f"{n}!" for r in rows for n in NAMES)
        assert stage(spark, odd.limit(0), SF).collect() == []
