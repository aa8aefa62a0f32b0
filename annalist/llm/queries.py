"""The ten operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprint, jaccard_join, language_id, licenses, mixing, substring_dedup, toxicity, warc
from .storage import new_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _part(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(_read(spark, sf_dir, "documents"), 13)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(*chat.turns_as_calls(_read(spark, sf_dir, "conversations")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic"), _part(5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(_part(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, columns=["doc_id", "source"]).select("doc_id", "size", "source_size", "target", "taken")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(F.coalesce(_part(4) != 2, F.lit(False))).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_part(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), path)
    found = warc.records(warc.read_chunks(spark, path, with_bytes=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_chat_formatting, op3_toxicity, op4_mixing, op5_licenses, op6_language_id, op7_decontamination, op8_fingerprints, op9_warc, op10_jaccard_join)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Queries without SQL are tested against brute force or held-out accuracy in tests/llm.
ORACLE_SQL = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM g),
f AS (SELECT t, min(doc_id) AS low FROM s GROUP BY t),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (t) WHERE low < doc_id),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN r USING (doc_id)),
x AS (SELECT k.doc_id, u.i, k.w[u.i] AS word FROM k, unnest(range(1, len(k.w) + 1)) AS u(i)),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.i WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT k.doc_id, len(w)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM k LEFT JOIN y ON y.doc_id = k.doc_id""",
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(text) AS n FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
t AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, ((total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level FROM t),
m AS (SELECT source, source_size, CASE WHEN level * w >= cap THEN cap::DOUBLE ELSE max(CASE WHEN level * w < cap THEN level END) OVER () * w END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM m),
k AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, greatest(0.0, e.target - e.epochs * e.source_size) AS budget,
  -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / coalesce(greatest(0.25, 1.0 / (1.0 + abs(d.n::DOUBLE / greatest(d.size, 1) - 6.0) / 6.0)), 0.25) AS key
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
b AS (SELECT *, floor((1.0 - exp(-key)) * 16384)::INT AS bin FROM k),
c AS (SELECT source, bin, sum(size) AS bin_size FROM b GROUP BY source, bin),
p AS (SELECT *, coalesce(sum(bin_size) OVER (PARTITION BY source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bin_before FROM c),
q AS (SELECT b.*, p.bin_before, p.bin_size,
  p.bin_before + coalesce(sum(b.size) OVER (PARTITION BY b.source, b.bin ORDER BY b.key, b.doc_id NULLS LAST, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source AND b.bin = p.bin)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN bin_before + bin_size <= budget THEN 1 WHEN bin_before >= budget THEN 0 WHEN before + size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f""",
}
