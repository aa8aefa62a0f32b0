"""Canonical version-history tables over the driver's tables.

Every projection is SQL that both Spark and DuckDB run, so queries and their
oracles start from the same rows.  Where a dialect differs there are two texts.
Windows are partitioned by customer or by day, never global.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Commits by order; the parents of a commit are older, so the graph has no cycle.
COMMITS = """
SELECT o_orderkey AS id, sha1(concat('commit ', CAST(o_orderkey AS STRING))) AS oid, o_custkey AS author,
  CAST(o_orderdate AS DATE) AS day, o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS weight,
  concat(o_orderpriority, ' change by ', CAST(o_custkey AS STRING), '; state ', o_orderstatus) AS message
FROM orders"""

#: First parent: the author's previous commit; a merge's second parent: the previous commit of the day.
EDGES = """
SELECT child, parent, ord FROM (
  SELECT id AS child, lag(id) OVER (PARTITION BY author ORDER BY day, id) AS parent, 0 AS ord FROM {commits}) a WHERE parent IS NOT NULL
UNION ALL
SELECT b.child, b.parent, 1 AS ord FROM (
  SELECT id AS child, lag(id) OVER (PARTITION BY day ORDER BY id) AS parent, lag(id) OVER (PARTITION BY author ORDER BY day, id) AS first FROM {commits}) b
WHERE b.parent IS NOT NULL AND b.first IS NOT NULL AND b.parent <> b.first AND b.child % 2 = 0"""

REFS = """
SELECT concat('refs/heads/', CAST(author AS STRING)) AS name, max_by(id, struct_key) AS id FROM (
  SELECT author, id, concat(CAST(day AS STRING), lpad(CAST(id AS STRING), 20, '0')) AS struct_key FROM {commits}) h GROUP BY author
UNION ALL
SELECT concat('refs/tags/v', CAST(id AS STRING)) AS name, id FROM {commits} WHERE priority = '1-URGENT'"""

TREES = """
SELECT l.l_orderkey AS commit_id, concat(p.p_brand, '/', p.p_type, '/', CAST(l.l_linenumber AS STRING)) AS path,
  sha1(concat(CAST(l.l_partkey AS STRING), ':', CAST(CAST(l.l_quantity AS BIGINT) AS STRING))) AS oid,
  CASE WHEN l.l_returnflag = 'R' THEN 33261 ELSE 33188 END AS mode, CAST(l.l_quantity AS BIGINT) AS size
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""

REFLOG = """
SELECT user_id AS ref, event_id AS new_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS nth, ts, event_type AS message
FROM events"""

STAGES = {
    "head": "SELECT doc_id AS path, sha1(text) AS oid, 33188 AS mode FROM documents WHERE doc_id % 7 <> 1",
    "staged": "SELECT doc_id AS path, sha1(CASE WHEN doc_id % 7 = 2 THEN concat(text, '!') ELSE text END) AS oid, 33188 AS mode FROM documents WHERE doc_id % 7 <> 3",
    "worktree": "SELECT doc_id AS path, sha1(CASE WHEN doc_id % 7 IN (2, 4) THEN concat(text, '?') ELSE text END) AS oid, CASE WHEN doc_id % 7 = 5 THEN 33261 ELSE 33188 END AS mode FROM documents WHERE doc_id % 7 <> 6",
}

#: Four newest branches: the tips of graph queries.
TIPS = "SELECT row_number() OVER (ORDER BY day DESC, id DESC) AS tip, id FROM (SELECT c.id, c.day FROM {refs} r JOIN {commits} c ON r.id = c.id WHERE r.name LIKE 'refs/heads/%' ORDER BY c.day DESC, c.id DESC LIMIT 4) t"

PROJECTIONS = {"commits": COMMITS, "edges": EDGES, "refs": REFS, "trees": TREES, "reflog": REFLOG, **STAGES, "tips": TIPS}

SPARK_LINES = "SELECT doc_id, CAST(pos + 1 AS BIGINT) AS n, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) e AS pos, line"
DUCK_LINES = "SELECT doc_id, CAST(unnest(generate_series(1, len(split(text, chr(10))))) AS BIGINT) AS n, unnest(split(text, chr(10))) AS line FROM documents"

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over base tables and ``{projections}``."""
    frames: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name not in frames:
            frames[name] = base(spark, sf_dir, name) if name in BASE else _sql(SPARK_LINES if name == "lines" else PROJECTIONS[name])
        return frames[name]

    def _sql(text: str) -> DataFrame:
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(BASE)})\b", r"\1 {\2}", text)
        return spark.sql(text, **{n: frame(n) for n in set(_names(text))})

    return _sql(sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"SELECT * FROM {{{name}}}")


def duck(sql: str) -> str:
    """The same query for DuckDB: projections become CTEs, in order of need."""
    need: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n not in BASE and n not in need:
                visit(DUCK_LINES if n == "lines" else PROJECTIONS[n])
                need.append(n)

    visit(sql)
    text = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', DUCK_LINES if n == 'lines' else PROJECTIONS[n]).strip()})" for n in need]
    if not parts:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + text[len("WITH RECURSIVE") :].strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:].strip()
    return "WITH " + ",\n".join(parts) + "\n" + text
