"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read back as the next stage's ``docs``.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import decontaminate, jaccard_join, language_id, mixing, substring_dedup
from annalist.llm.storage import stored

#: Documents whose best language has a lower mean probability are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.3
#: Words of a passage that must not repeat across documents.
PASSAGE_WORDS = 50


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row in one column, so that no column's name can clash with a stage's own."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents teach."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.predict(_packed(docs), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, an id of each row; of rows of one id, or without id, that have the same words one stays.

    A key is the row's id, or a hash above all ids for rows without an id and for the texts
    of a repeated id but that with the smallest digest.
    """
    odd = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "odd_ids")
    keyed = docs.withColumn("_key", F.col("doc_id").cast("long"))
    if odd.isEmpty():
        return keyed
    high = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    repeats = docs.where("doc_id is null").unionByName(docs.join(odd, "doc_id", "left_semi")).withColumn("_words", F.sha2(words, 256))
    one = repeats.groupBy("doc_id", "_words").agg(F.min(F.struct(*docs.columns)).alias("r"))
    one = stored(one.select("_words", "r.*"), "odd_rows")
    first = one.groupBy("doc_id").agg(F.min("_words").alias("_first"))
    above = F.lit(high + 1) + F.pmod(F.xxhash64("doc_id", "_words"), F.lit(max(1, (1 << 63) - 2 - high)))
    one = one.join(first, "doc_id", "left").withColumn("_key", F.when(F.col("_words") == F.col("_first"), F.col("doc_id").cast("long")).otherwise(above))
    return keyed.where("doc_id is not null").join(odd, "doc_id", "left_anti").select(*docs.columns, "_key").unionByName(one.select(*docs.columns, "_key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at 0.8: that with the smallest key (see ``_keyed``)."""
    keyed = _keyed(docs)
    found = jaccard_join.jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text"), words=5, percent=80)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(gone.hint("shuffle_hash"), "_key", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one; a document that loses every word goes."""
    cut = substring_dedup.substring_dedup(_packed(docs), PASSAGE_WORDS).where("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(_packed(docs), items).where(~F.col("is_contaminated")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of each (repeats counted)."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: A trained network decides the first stage, which SQL can't express: tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
