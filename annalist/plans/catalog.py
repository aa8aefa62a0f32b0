"""Registered queries of the engine's own operators and their SQL twins.

``_sql`` registers a relational query whose text both engines run (or a text for
each where the dialects differ); ``_graph`` registers a DataFrame plan of
``operators.graph`` beside a recursive SQL twin.  Numbers in docstrings and names
are those of the survey's operator inventory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_diff
from ..operators import graph
from . import projection as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(name: str, text: str, duck: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir, text=text: P.run(spark, sf_dir, text)
    ORACLE_SQL[name] = P.duck(duck or text)


def _graph(name: str, duck: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = P.duck(duck)
        return f

    return register


# --- 2.1 scans -------------------------------------------------------------------------------

_sql("object_ids", "SELECT DISTINCT sha1(text) AS oid FROM documents")  # 2.1.3, 2.6.11
_sql("object_header", "SELECT doc_id, 'blob' AS type, octet_length(text) AS size FROM documents", "SELECT doc_id, 'blob' AS type, strlen(text) AS size FROM documents")  # 2.1.2
_sql("object_lookup", "SELECT d.doc_id, CASE WHEN c.id IS NULL THEN 'missing' ELSE c.oid END AS oid FROM labels d LEFT JOIN {commits} c ON d.doc_id = c.id")  # 2.1.1, 2.1.41
_sql("prefix_scan", "SELECT id, oid FROM {commits} WHERE oid LIKE 'ab%'")  # 2.1.4
_sql("prefix_resolve", "SELECT substr(oid, 1, 3) AS prefix, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS state, count(*) AS n, min(oid) AS first FROM {commits} GROUP BY substr(oid, 1, 3)")  # 2.1.5
_sql("typed_disambiguation", """
SELECT prefix, count(*) AS n, count(CASE WHEN type = 'commit' THEN 1 END) AS commits, CASE WHEN count(CASE WHEN type = 'commit' THEN 1 END) = 1 THEN max(CASE WHEN type = 'commit' THEN oid END) END AS resolved
FROM (SELECT substr(oid, 1, 3) AS prefix, oid, 'commit' AS type FROM {commits} UNION ALL SELECT DISTINCT substr(sha1(text), 1, 3), sha1(text), 'blob' FROM documents) o GROUP BY prefix""")  # 2.1.6
_sql("pack_reverse_index", "SELECT l_orderkey AS pack, l_linenumber AS obj, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS pos FROM lineitem")  # 2.1.11
_sql("multi_pack_index", "SELECT l_partkey AS obj, max(l_shipdate) AS newest, max_by(l_orderkey, concat(CAST(l_shipdate AS STRING), lpad(CAST(l_orderkey AS STRING), 20, '0'))) AS pack FROM lineitem GROUP BY l_partkey")  # 2.1.10, 2.2.12
_sql("commit_scan", "SELECT id, oid, author, CAST(day AS STRING) AS day, message FROM {commits}")  # 2.1.15
_sql("refs_scan", "SELECT name, id FROM {refs}")  # 2.1.16
_sql("refs_prefix", "SELECT name, id FROM {refs} WHERE name LIKE 'refs/heads/1%'")  # 2.1.17
_sql("refs_loose_over_packed", """
SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY rank) AS r FROM (
  SELECT name, id, 1 AS rank FROM {refs} WHERE id % 2 = 0 UNION ALL SELECT name, id - 1 AS id, 2 AS rank FROM {refs}) u) v WHERE r = 1""")  # 2.1.16, 2.1.20, 2.2.26
_sql("reflog_scan", "SELECT ref, nth, old_id, new_id, message FROM {reflog}")  # 2.1.21, 2.7.1
_sql("ls_tree", "SELECT concat(CASE WHEN mode = 33261 THEN '100755' ELSE '100644' END, ' blob ', oid, ' ', path) AS entry, commit_id FROM {trees}")  # 2.1.25, 2.3.13
_sql("ls_files", """
SELECT coalesce(s.path, w.path) AS path, CASE WHEN s.path IS NULL THEN 'other' WHEN w.path IS NULL THEN 'deleted' WHEN s.oid <> w.oid THEN 'modified' ELSE 'cached' END AS state
FROM {staged} s FULL OUTER JOIN {worktree} w ON s.path = w.path""")  # 2.1.26, 2.1.27
_sql("config_effective", """
SELECT skey, max_by(value, rank) AS value, count(*) AS n FROM (
  SELECT event_type AS skey, CAST(user_id AS STRING) AS value, concat(CAST(user_id % 5 AS STRING), ':', lpad(CAST(event_id AS STRING), 20, '0')) AS rank FROM events) c GROUP BY skey""")  # 2.1.29, 2.6.15
_sql("config_get_all", "SELECT event_type AS skey, user_id % 5 AS scope, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY event_type, user_id % 5")  # 2.6.14
_sql("mailmap", "SELECT c.id, coalesce(m.c_name, concat('unknown ', CAST(c.author AS STRING))) AS ident FROM {commits} c LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0) m ON c.author = m.c_custkey")  # 2.1.30, 2.10.7
_sql("notes_scan", "SELECT d.doc_id AS annotated, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")  # 2.1.32
_sql("shallow_cut", "SELECT e.child, e.parent, e.ord FROM {edges} e LEFT JOIN (SELECT id FROM {commits} WHERE id % 10 = 0) s ON e.child = s.id WHERE s.id IS NULL")  # 2.1.38
_sql("replace_overlay", "SELECT e.child, coalesce(r.parent, e.parent) AS parent FROM {edges} e LEFT JOIN {edges} r ON e.parent = r.child AND r.ord = 0 AND e.parent % 10 = 0 WHERE e.ord = 0")  # 2.1.39
_sql("promised_objects", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'present' WHEN d.doc_id % 2 = 0 THEN 'promised' ELSE 'missing' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")  # 2.1.40
_sql("count_objects", "SELECT count(*) AS objects, count(DISTINCT sha1(text)) AS different, CAST(sum(octet_length(text)) AS BIGINT) AS bytes FROM documents", "SELECT count(*) AS objects, count(DISTINCT sha1(text)) AS different, sum(strlen(text))::BIGINT AS bytes FROM documents")  # 2.1.42

# --- 2.2 sinks -------------------------------------------------------------------------------

_sql("hash_object", "SELECT doc_id, sha1(concat(encode(concat('blob ', CAST(octet_length(text) AS STRING)), 'utf-8'), X'00', encode(text, 'utf-8'))) AS oid FROM documents", "SELECT doc_id, sha1(encode('blob ' || strlen(text)::VARCHAR) || '\\x00'::BLOB || encode(text)) AS oid FROM documents")  # 2.2.2, 2.2.3
_sql("object_write_idempotent", "SELECT oid, min(doc_id) AS first, count(*) AS copies FROM (SELECT sha1(text) AS oid, doc_id FROM documents) d GROUP BY oid")  # 2.2.1
_sql("cruft_objects", "SELECT c.id, CAST(c.day AS STRING) AS day FROM {commits} c LEFT JOIN {refs} r ON c.id = r.id LEFT JOIN {edges} e ON c.id = e.parent WHERE r.id IS NULL AND e.parent IS NULL")  # commits without a ref or a child; 2.2.9 and 2.2.10 are unreachable_from_tags
_sql("ref_transaction", "SELECT r.name, r.id AS old_id, r.id + 1 AS new_id, CASE WHEN r.id % 3 = 0 THEN 'reject' ELSE 'update' END AS outcome FROM {refs} r")  # 2.2.18, 2.2.19

# --- 2.3 projections -------------------------------------------------------------------------

_sql("log_format", "SELECT id, concat(substr(oid, 1, 7), ' ', CAST(day AS STRING), ' <', CAST(author AS STRING), '> ', message) AS line FROM {commits}")  # 2.3.1, 2.3.2
_sql("ref_format_conditional", "SELECT name, CASE WHEN name LIKE 'refs/tags/%' THEN concat('tag ', substr(name, 11)) ELSE concat('branch ', substr(name, 12)) END AS shown FROM {refs}")  # 2.3.4, 2.3.5, 2.3.18
_sql("align_atom", "SELECT name, rpad(name, 24, ' ') AS padded_left, lpad(name, 24, ' ') AS padded_right FROM {refs}")  # 2.3.6, 2.3.10
_sql("shell_quote", "SELECT doc_id, concat('''', replace(coalesce(text, ''), '''', '''\\\\'''''), '''') AS quoted FROM documents", "SELECT doc_id, '''' || array_to_string(string_split(coalesce(text, ''), ''''), '''\\''''') || '''' AS quoted FROM documents")  # 2.3.8
_LCP = " ".join(f"WHEN substr(a, 1, {n}) <> substr(b, 1, {n}) THEN {n}" for n in range(1, 40))
_sql("oid_abbrev", f"""
SELECT oid, substr(oid, 1, greatest(4, greatest(p, q))) AS abbrev FROM (
  SELECT oid, (CASE WHEN prev IS NULL THEN 1 {_LCP.replace('substr(a', 'substr(oid').replace('substr(b', 'substr(prev')} ELSE 40 END) AS p, (CASE WHEN next IS NULL THEN 1 {_LCP.replace('substr(a', 'substr(oid').replace('substr(b', 'substr(next')} ELSE 40 END) AS q FROM (
    SELECT oid, lag(oid) OVER (PARTITION BY substr(oid, 1, 1) ORDER BY oid) AS prev, lead(oid) OVER (PARTITION BY substr(oid, 1, 1) ORDER BY oid) AS next FROM {{commits}}) w) x""")  # 2.3.16, 2.7.2
_sql("short_refname", """
SELECT r.name, CASE WHEN t.short IS NULL OR r.name LIKE 'refs/tags/%' THEN r.short ELSE concat('heads/', r.short) END AS short FROM (
  SELECT name, CASE WHEN name LIKE 'refs/tags/%' THEN substr(name, 11) ELSE substr(name, 12) END AS short FROM {refs}) r
LEFT JOIN (SELECT substr(name, 12) AS short FROM {refs} WHERE name LIKE 'refs/tags/%') t ON r.short = t.short""")  # 2.3.17
_sql("decorations", "SELECT id, count(*) AS n, min(name) AS first, max(name) AS last FROM {refs} GROUP BY id")  # 2.3.19

# --- 2.4 predicates --------------------------------------------------------------------------

_sql("date_window", "SELECT id FROM {commits} WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")  # 2.4.1, 2.4.2
_sql("parent_count_filter", "SELECT c.id, count(e.parent) AS parents FROM {commits} c LEFT JOIN {edges} e ON c.id = e.child GROUP BY c.id HAVING count(e.parent) >= 2")  # 2.4.3
_sql("author_filter", "SELECT c.id FROM {commits} c JOIN customer u ON c.author = u.c_custkey WHERE u.c_name LIKE '%7%'")  # 2.4.4, 2.4.5
_sql("message_grep_any", "SELECT id FROM {commits} WHERE message LIKE '%URGENT%' OR message LIKE '%state P%'")  # 2.4.6
_sql("message_grep_all_inverted", "SELECT id FROM {commits} WHERE NOT (message LIKE '%HIGH%' AND message LIKE '%state F%')")  # 2.4.6
_sql("grep_lines", "SELECT doc_id, n, line FROM {lines} WHERE lower(line) LIKE '%license%'")  # 2.4.7, 2.4.14
_sql("grep_count", "SELECT doc_id, count(*) AS hits FROM {lines} WHERE line LIKE '%the%' GROUP BY doc_id")  # 2.4.8
_sql("grep_boolean", "SELECT doc_id, n FROM {lines} WHERE (line LIKE '%tion%' OR line LIKE '%keit%') AND NOT line LIKE '%the%'")  # 2.4.9
_sql("grep_all_match", "SELECT doc_id FROM {lines} GROUP BY doc_id HAVING max(CASE WHEN line LIKE '%tion%' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN line LIKE '%ness%' OR line LIKE '%ing%' THEN 1 ELSE 0 END) = 1")  # 2.4.11
_sql("grep_context", """
SELECT doc_id, n, hit FROM (SELECT doc_id, n, CASE WHEN line LIKE '%License%' THEN 1 ELSE 0 END AS hit,
  max(CASE WHEN line LIKE '%License%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM {lines}) w WHERE near = 1""")  # 2.4.12, 2.7.6
_sql("grep_max_count", "SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM {lines} WHERE line LIKE '%an%') g WHERE r <= 2")  # 2.4.8
_sql("pathspec", "SELECT commit_id, path FROM {trees} WHERE (path LIKE 'Brand#1%' OR path LIKE '%/STANDARD%') AND NOT path LIKE '%/3'")  # 2.4.15, 2.4.16
_sql("object_filter", "SELECT commit_id, path, size FROM {trees} WHERE size < 10")  # 2.4.22: blob:limit keeps size < n
_sql("ignore_last_match", """
SELECT path, max_by(state, seq) AS state FROM (
  SELECT path, 'ignored' AS state, 1 AS seq FROM {trees} WHERE path LIKE 'Brand#2%' UNION ALL
  SELECT path, 'kept', 2 FROM {trees} WHERE path LIKE '%/2' UNION ALL
  SELECT path, 'ignored', 3 FROM {trees} WHERE path LIKE 'Brand#23/%') m GROUP BY path""")  # 2.4.19
_sql("refname_pattern", "SELECT name FROM {refs} WHERE (name = 'refs/heads/1' OR name LIKE 'refs/tags/%') AND NOT name LIKE '%9'")  # 2.4.28, 2.4.29
_sql("points_at", "SELECT r.name FROM {refs} r JOIN {tips} t ON r.id = t.id")  # 2.4.30
_sql("hidden_refs", "SELECT name FROM {refs} WHERE CASE WHEN name LIKE 'refs/heads/1%' THEN true WHEN name LIKE 'refs/heads/%' THEN false ELSE true END")  # 2.4.31
_sql("pickaxe", """
SELECT doc_id, old_n, new_n FROM (SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) / 3 AS new_n, lag((length(text) - length(replace(text, 'the', ''))) / 3) OVER (PARTITION BY source ORDER BY doc_id) AS old_n FROM documents) p WHERE old_n <> new_n""")  # 2.4.26
_sql("diff_filter_all_or_none", "SELECT path, state FROM (SELECT path, state, max(CASE WHEN state = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY path % 10) AS any_deleted FROM (SELECT coalesce(h.path, s.path) AS path, CASE WHEN h.path IS NULL THEN 'A' WHEN s.path IS NULL THEN 'D' WHEN h.oid <> s.oid THEN 'M' ELSE '=' END AS state FROM {head} h FULL OUTER JOIN {staged} s ON h.path = s.path) d WHERE state <> '=') f WHERE any_deleted = 1")  # 2.4.25
_sql("ref_name_check", "SELECT name, name LIKE 'refs/%' AND NOT name LIKE '%..%' AND NOT name LIKE '%/' AND NOT name LIKE '%.lock' AS valid FROM {refs}")  # 2.4.35

# --- 2.5 joins -------------------------------------------------------------------------------

_DIFF = "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' WHEN a.oid <> b.oid OR a.mode <> b.mode THEN 'M' END AS state FROM {%s} a FULL OUTER JOIN {%s} b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.oid <> b.oid OR a.mode <> b.mode"
_sql("diff_tree_index", _DIFF % ("head", "staged"))  # 2.5.34, 2.5.35
_sql("diff_index_worktree", _DIFF % ("staged", "worktree"))  # 2.5.36
_sql("diff_tree_worktree", _DIFF % ("head", "worktree"))  # 2.5.37
_sql("status_xy", """
SELECT coalesce(h.path, s.path, w.path) AS path,
  CASE WHEN s.path IS NULL AND h.path IS NULL THEN '?' WHEN s.path IS NULL THEN 'D' WHEN h.path IS NULL THEN 'A' WHEN h.oid <> s.oid OR h.mode <> s.mode THEN 'M' ELSE ' ' END AS x,
  CASE WHEN s.path IS NULL AND h.path IS NULL THEN '?' WHEN s.path IS NULL THEN ' ' WHEN w.path IS NULL THEN 'D' WHEN s.oid <> w.oid OR s.mode <> w.mode THEN 'M' ELSE ' ' END AS y
FROM {head} h FULL OUTER JOIN {staged} s ON h.path = s.path FULL OUTER JOIN {worktree} w ON coalesce(h.path, s.path) = w.path""")  # 2.5.44
_sql("combined_diff", "SELECT w.path FROM {worktree} w JOIN {head} h ON w.path = h.path JOIN {staged} s ON w.path = s.path WHERE w.oid <> h.oid AND w.oid <> s.oid")  # 2.5.45
_sql("three_way_merge", """
SELECT coalesce(h.path, s.path, w.path) AS path, CASE
  WHEN s.oid IS NOT DISTINCT FROM w.oid THEN 'same' WHEN h.oid IS NOT DISTINCT FROM s.oid THEN 'theirs' WHEN h.oid IS NOT DISTINCT FROM w.oid THEN 'ours'
  WHEN s.oid IS NULL OR w.oid IS NULL THEN 'modify/delete' WHEN h.oid IS NULL THEN 'add/add' ELSE 'content' END AS outcome
FROM {head} h FULL OUTER JOIN {staged} s ON h.path = s.path FULL OUTER JOIN {worktree} w ON coalesce(h.path, s.path) = w.path""".replace("IS NOT DISTINCT FROM", "<=>"), """
SELECT coalesce(h.path, s.path, w.path) AS path, CASE
  WHEN s.oid IS NOT DISTINCT FROM w.oid THEN 'same' WHEN h.oid IS NOT DISTINCT FROM s.oid THEN 'theirs' WHEN h.oid IS NOT DISTINCT FROM w.oid THEN 'ours'
  WHEN s.oid IS NULL OR w.oid IS NULL THEN 'modify/delete' WHEN h.oid IS NULL THEN 'add/add' ELSE 'content' END AS outcome
FROM {head} h FULL OUTER JOIN {staged} s ON h.path = s.path FULL OUTER JOIN {worktree} w ON coalesce(h.path, s.path) = w.path""")  # 2.5.46, 2.5.49
_GONE = "SELECT h.path, h.oid FROM {head} h LEFT JOIN {staged} s ON h.path = s.path WHERE s.path IS NULL"
_NEW = "SELECT s.path, s.oid FROM {staged} s LEFT JOIN {head} h ON h.path = s.path WHERE h.path IS NULL"
# a deleted path serves one added path: the k-th of an object's deleted paths the k-th of its added ones
_sql("exact_rename", f"""
SELECT d.path AS src, a.path AS dst FROM (SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS k FROM ({_GONE}) g) d
JOIN (SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS k FROM ({_NEW}) n) a ON d.oid = a.oid AND d.k = a.k""", f"""
SELECT unnest(list_slice(d.paths, 1, least(len(d.paths), len(a.paths)))) AS src, unnest(list_slice(a.paths, 1, least(len(d.paths), len(a.paths)))) AS dst
FROM (SELECT oid, list(path ORDER BY path) AS paths FROM ({_GONE}) g GROUP BY oid) d JOIN (SELECT oid, list(path ORDER BY path) AS paths FROM ({_NEW}) n GROUP BY oid) a ON d.oid = a.oid""")  # 2.5.38
_sql("exact_copy", "SELECT s.path AS dst, min(h.path) AS src FROM {staged} s JOIN {head} h ON s.oid = h.oid AND s.path <> h.path GROUP BY s.path")  # 2.5.39
_sql("reflog_ends", "SELECT ref, max_by(new_id, nth) AS oldest, min_by(new_id, nth) AS newest, count(*) AS n FROM {reflog} GROUP BY ref")  # oldest and newest entries
# the newest entry up to the date; null for a ref whose log starts later
_sql("reflog_as_of", """
SELECT ref, max_by(new_id, CASE WHEN ts <= TIMESTAMP '2024-01-15 12:00:00' THEN -nth END) AS id, count(CASE WHEN ts <= TIMESTAMP '2024-01-15 12:00:00' THEN 1 END) AS n FROM {reflog} GROUP BY ref""", """
SELECT r.ref, a.id, coalesce(a.n, 0) AS n FROM (SELECT DISTINCT ref FROM {reflog}) r
LEFT JOIN (SELECT user_id AS ref, arg_max(event_id, (ts, event_id)) AS id, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id) a ON r.ref = a.ref""")  # 2.5.52
_sql("reflog_nth", "SELECT ref, new_id FROM {reflog} WHERE nth = 3")  # 2.5.52
_sql("last_modified", "SELECT path, max_by(commit_id, concat(CAST(c.day AS STRING), lpad(CAST(c.id AS STRING), 20, '0'))) AS commit_id FROM {trees} t JOIN {commits} c ON t.commit_id = c.id GROUP BY path")  # 2.5.53
_sql("interval_set", """
SELECT part, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM (SELECT part, lo, hi, sum(fresh) OVER (PARTITION BY part ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
  SELECT part, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY part ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
    SELECT DISTINCT l_partkey AS part, l_orderkey AS lo, l_orderkey + 40 * l_linenumber AS hi FROM lineitem) i) g) s GROUP BY part, island""")  # 2.5.57
_sql("connectivity_missing", "SELECT e.child, e.parent FROM {edges} e LEFT JOIN (SELECT id FROM {commits} WHERE id % 11 <> 0) c ON e.parent = c.id WHERE c.id IS NULL")  # 2.5.61
_sql("connectivity_dangling", "SELECT c.id FROM {commits} c LEFT JOIN {edges} e ON c.id = e.parent WHERE e.parent IS NULL")  # 2.5.61
_sql("ref_check", "SELECT r.name, CASE WHEN c.id IS NULL THEN 'missing' ELSE 'ok' END AS state FROM {refs} r LEFT JOIN (SELECT id FROM {commits} WHERE id % 5 <> 0) c ON r.id = c.id")  # 2.5.62
_sql("ref_map", "SELECT name AS src, concat('refs/remotes/origin/', substr(name, 12)) AS dst, id FROM {refs} WHERE name LIKE 'refs/heads/%'")  # 2.5.64
_sql("push_plan", "SELECT coalesce(l.name, r.name) AS name, r.id AS old_id, l.id AS new_id, CASE WHEN l.name IS NULL THEN 'delete' WHEN r.name IS NULL THEN 'create' WHEN l.id <> r.id THEN 'update' ELSE 'same' END AS action FROM (SELECT name, id FROM {refs} WHERE id % 4 <> 0) l FULL OUTER JOIN (SELECT name, id - (id % 3) AS id FROM {refs} WHERE id % 5 <> 0) r ON l.name = r.name")  # 2.5.65
_sql("children", "SELECT parent, count(*) AS n, min(child) AS first, max(child) AS last FROM {edges} GROUP BY parent")  # 2.5.30
_PATCHES = "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<' ELSE '>' END AS side, sha1(replace(text, ' ', '')) AS oid FROM documents)"
_sql("cherry_marks", f"""
SELECT p.doc_id, p.side, CASE WHEN b.oid IS NULL THEN '+' ELSE '=' END AS mark FROM {_PATCHES} p
LEFT JOIN (SELECT oid FROM {_PATCHES} q GROUP BY oid HAVING min(side) <> max(side)) b ON p.oid = b.oid""", f"SELECT doc_id, side, CASE WHEN EXISTS (SELECT 1 FROM {_PATCHES} q WHERE q.oid = p.oid AND q.side <> p.side) THEN '=' ELSE '+' END AS mark FROM {_PATCHES} p")  # 2.5.31, 2.5.32
_sql("notes_merge", "SELECT coalesce(a.doc_id, b.doc_id) AS annotated, CASE WHEN a.doc_id IS NULL THEN 'theirs' WHEN b.doc_id IS NULL THEN 'ours' WHEN a.quality = b.toxic THEN 'same' ELSE 'union' END AS outcome FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) a FULL OUTER JOIN (SELECT doc_id, toxic FROM labels WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id")  # 2.5.51

# --- 2.6 aggregates --------------------------------------------------------------------------

_sql("shortlog", "SELECT u.c_name AS author, count(*) AS n, min(c.id) AS first, max(c.id) AS last FROM {commits} c JOIN customer u ON c.author = u.c_custkey GROUP BY u.c_name")  # 2.6.1
# ranks: rows of greater counts, then of lower buckets of authors, then inside the bucket, so no window holds all authors
_sql("shortlog_numbered", """
WITH s AS (SELECT author, floor(author / 1000) AS part, count(*) AS n FROM {commits} GROUP BY author),
h AS (SELECT n, part, sum(rows) OVER (ORDER BY n DESC, part NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rows AS before FROM (SELECT n, part, count(*) AS rows FROM s GROUP BY n, part) c)
SELECT s.author, s.n, h.before + row_number() OVER (PARTITION BY s.n, s.part ORDER BY s.author) AS rank FROM s JOIN h ON s.n = h.n AND s.part <=> h.part""", "SELECT author, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, author NULLS LAST) AS rank FROM {commits} GROUP BY author")  # 2.6.2
_sql("shortstat", "SELECT commit_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS insertions FROM {trees} GROUP BY commit_id")  # 2.6.5, 2.6.6
# sizes are summed by directory before anything else; the total is one row
_sql("dirstat_cumulative", """
WITH low AS (SELECT substring_index(path, '/', 2) AS dir, sum(size) AS size FROM {trees} GROUP BY 1),
d AS (SELECT concat(dir, '/') AS dir, size FROM low UNION ALL SELECT concat(substring_index(dir, '/', 1), '/'), size FROM low)
SELECT dir, CAST(sum(size) AS BIGINT) AS damage, CAST(floor(sum(size) * 1000 / (SELECT sum(size) FROM low)) AS BIGINT) AS permille FROM d GROUP BY dir""", """
SELECT dir, sum(size)::BIGINT AS damage, floor(sum(size) * 1000 / max(total))::BIGINT AS permille FROM (
  SELECT concat(split(path, '/')[1], '/') AS dir, size, sum(size) OVER () AS total FROM {trees} UNION ALL
  SELECT concat(split(path, '/')[1], '/', split(path, '/')[2], '/'), size, sum(size) OVER () FROM {trees}) d GROUP BY dir""")  # 2.6.8
_sql("disk_usage", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")  # 2.6.12
_sql("pseudo_merge_groups", "SELECT name, ntile(8) OVER (PARTITION BY substr(name, 1, 10) ORDER BY id, name) AS part FROM {refs}")  # 2.6.19

# --- 2.7 and 2.8 windows and orders ----------------------------------------------------------

_sql("patch_numbering", "SELECT author, id, row_number() OVER (PARTITION BY author ORDER BY day, id) AS n, count(*) OVER (PARTITION BY author) AS m FROM {commits}")  # 2.7.4, 2.7.3
_sql("thread_plan", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to, min(turn) OVER (PARTITION BY conv_id) AS root FROM conversations")  # 2.7.5
_sql("line_numbers", "SELECT doc_id, count(*) AS n, max(n) AS last FROM {lines} GROUP BY doc_id")  # 2.7.7
_sql("newest_commits", "SELECT id, CAST(day AS STRING) AS day FROM {commits} ORDER BY day DESC, id LIMIT 25")  # 2.8.4, 2.8.6
_sql("oldest_commits", "SELECT id, CAST(day AS STRING) AS day FROM {commits} ORDER BY day, id LIMIT 25")  # 2.8.16
_sql("refs_page", "SELECT name, id FROM {refs} WHERE name > 'refs/heads/2' ORDER BY name LIMIT 20")  # 2.8.11
_sql("refs_sorted", """
WITH s AS (SELECT r.name, substr(r.name, 1, 13) AS part, c.priority FROM {refs} r JOIN {commits} c ON r.id = c.id),
h AS (SELECT priority, part, sum(rows) OVER (ORDER BY priority NULLS LAST, part DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rows AS before FROM (SELECT priority, part, count(*) AS rows FROM s GROUP BY priority, part) c)
SELECT s.name, s.priority, h.before + row_number() OVER (PARTITION BY s.priority, s.part ORDER BY s.name DESC) AS rank FROM s JOIN h ON s.priority <=> h.priority AND s.part <=> h.part""", "SELECT r.name, c.priority, row_number() OVER (ORDER BY c.priority NULLS LAST, r.name DESC) AS rank FROM {refs} r JOIN {commits} c ON r.id = c.id")  # 2.8.8, 2.8.9
# entries of each tree; the name of a subtree sorts as if it ended in a slash
_sql("tree_order", """
SELECT tree, name, row_number() OVER (PARTITION BY tree ORDER BY k) AS pos FROM (
  SELECT DISTINCT e.tree, e.name, concat(e.name, CASE WHEN e.deep THEN '/' ELSE '' END) AS k FROM (
    SELECT inline(transform(sequence(1, size(split(path, '/'))), i -> struct(substring_index(path, '/', i - 1) AS tree, split(path, '/')[i - 1] AS name, i < size(split(path, '/')) AS deep))) FROM {trees}) e) t""", """
WITH e AS (SELECT DISTINCT '' AS tree, split_part(path, '/', 1) AS name, split_part(path, '/', 1) || '/' AS k FROM {trees} UNION ALL
  SELECT DISTINCT split_part(path, '/', 1), split_part(path, '/', 2), split_part(path, '/', 2) || '/' FROM {trees} UNION ALL
  SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 3), split_part(path, '/', 3) FROM {trees})
SELECT a.tree, a.name, count(*) AS pos FROM e a JOIN e b ON a.tree = b.tree AND b.k <= a.k GROUP BY a.tree, a.name""")  # 2.8.12

# --- 2.10 to 2.12 scalar functions -----------------------------------------------------------

_sql("subject_body", "SELECT doc_id, split_part(text, chr(10), 1) AS subject, length(text) - length(split_part(text, chr(10), 1)) AS body_chars FROM documents")  # 2.10.1, 2.10.2
_sql("sanitised_subject", "SELECT id, regexp_replace(regexp_replace(message, '[^A-Za-z0-9._]+', '-'), '^-|-$', '') AS slug FROM {commits}", "SELECT id, regexp_replace(regexp_replace(message, '[^A-Za-z0-9._]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM {commits}")  # 2.10.3
_sql("stripspace", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t]+\\n', '\n'), '\\n\\n\\n+', '\n\n') AS text FROM documents", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g') AS text FROM documents")  # 2.10.11
_sql("whitespace_check", "SELECT doc_id, n, CASE WHEN line LIKE '% ' THEN 1 ELSE 0 END + CASE WHEN line LIKE ' %' THEN 2 ELSE 0 END AS flags FROM {lines} WHERE line LIKE '% ' OR line LIKE ' %'")  # 2.10.12
_sql("url_redact", "SELECT page_id, regexp_replace(url, '//[^/@]*@', '//') AS url FROM pages")  # 2.10.21
_sql("size_units", "SELECT doc_id, CASE WHEN n_chars >= 1024 THEN concat(CAST(CAST(floor(n_chars / 1024) AS BIGINT) AS STRING), ' KiB') ELSE concat(CAST(n_chars AS STRING), ' bytes') END AS size FROM documents")  # 2.12.11
_sql("bool_parse", "SELECT event_id, CASE WHEN event_type IN ('true', 'yes', 'on', 'click') THEN true WHEN event_type IN ('false', 'no', 'off', '') THEN false END AS value FROM events")  # 2.12.10
_sql("mode_kind", "SELECT path, CASE mode WHEN 33188 THEN 'file' WHEN 33261 THEN 'executable' WHEN 40960 THEN 'symlink' WHEN 16384 THEN 'tree' WHEN 57344 THEN 'gitlink' END AS kind FROM {worktree}")  # 2.12.13
_sql("reflog_expire", "SELECT ref, new_id, nth FROM {reflog} WHERE nth = 0 OR new_id % 4 <> 0")  # 2.14.7: the newest entry always stays

# --- graph queries ---------------------------------------------------------------------------

_REACH = "WITH RECURSIVE walk AS (SELECT tip, id FROM {tips} UNION SELECT w.tip, e.parent FROM walk w JOIN {edges} e ON w.id = e.child)"


def _walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, tips, closure of all tips)."""
    edges, tips = graph.stored_edges(P.table(spark, sf_dir, "edges")), P.table(spark, sf_dir, "tips")
    return edges, tips, graph.closure(edges, tips)


@_graph("reachable", f"{_REACH} SELECT tip, id FROM walk")  # 2.5.1, 2.5.2, 2.5.5; bodies and objects: commit_walk_bodies, object_closure
def _(spark, sf_dir):
    return _walked(spark, sf_dir)[2].select("tip", "id")


@_graph("reachable_count", f"{_REACH} SELECT tip, count(*) AS n FROM walk GROUP BY tip")  # 2.5.3
def _(spark, sf_dir):
    return _walked(spark, sf_dir)[2].groupBy("tip").agg(F.count(F.lit(1)).alias("n"))


_A_NOT_B = "(SELECT DISTINCT id FROM walk WHERE tip = 1 AND id NOT IN (SELECT id FROM walk WHERE tip = 2))"


@_graph("rev_list_range", f"{_REACH} SELECT id, CAST(day AS STRING) AS day, row_number() OVER (ORDER BY day DESC, id) AS rank FROM (SELECT c.id, c.day FROM {_A_NOT_B} s JOIN {{commits}} c ON s.id = c.id WHERE (SELECT count(*) FROM {{edges}} e WHERE e.child = c.id) <= 2 ORDER BY c.day DESC, c.id LIMIT 5) t")  # 2.5.9, 2.8.6
def _(spark, sf_dir):
    edges, _, reached = _walked(spark, sf_dir)
    commits = P.table(spark, sf_dir, "commits")
    # filters come before the limit
    parents = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"))
    found = graph.difference(reached, [1], [2]).join(commits, "id").join(parents, F.col("id") == F.col("child"), "left").where(F.coalesce("n", F.lit(0)) <= 2)
    from pyspark.sql import Window

    top = found.orderBy(F.desc("day"), "id").limit(5)
    return top.select("id", F.col("day").cast("string").alias("day"), F.row_number().over(Window.orderBy(F.desc("day"), "id")).alias("rank"))


@_graph("range_difference", f"{_REACH} SELECT id FROM {_A_NOT_B} d")  # 2.5.10, 2.9.2
def _(spark, sf_dir):
    return graph.difference(_walked(spark, sf_dir)[2], [1], [2])


@_graph("range_symmetric", f"{_REACH} SELECT id, CASE WHEN min(tip) = 1 THEN '<' ELSE '>' END AS side FROM walk WHERE tip IN (1, 2) GROUP BY id HAVING count(*) = 1")  # 2.9.3
def _(spark, sf_dir):
    return graph.symmetric(_walked(spark, sf_dir)[2], 1, 2)


@_graph("multi_tip_selection", f"{_REACH} SELECT DISTINCT id FROM walk WHERE tip IN (1, 3) AND id NOT IN (SELECT id FROM walk WHERE tip IN (2, 4))")  # 2.5.11
def _(spark, sf_dir):
    return graph.difference(_walked(spark, sf_dir)[2], [1, 3], [2, 4])


@_graph("ahead_behind", f"{_REACH}, s AS (SELECT id, min(tip) AS t FROM walk WHERE tip IN (1, 2) GROUP BY id HAVING count(*) = 1) SELECT count(CASE WHEN t = 1 THEN 1 END) AS ahead, count(CASE WHEN t = 2 THEN 1 END) AS behind FROM s")  # 2.5.19
def _(spark, sf_dir):
    return graph.ahead_behind(_walked(spark, sf_dir)[2], 1, 2)


_COMMON = "c AS (SELECT id FROM walk WHERE tip IN ({0}) GROUP BY id HAVING count(DISTINCT tip) = {1}) SELECT id FROM c WHERE id NOT IN (SELECT e.parent FROM {{edges}} e JOIN c ON e.child = c.id)"


@_graph("merge_base", f"{_REACH}, {_COMMON.format('1, 2', 2)}")  # 2.5.14
def _(spark, sf_dir):
    edges, _, reached = _walked(spark, sf_dir)
    return graph.merge_bases(edges, reached, [1, 2])


@_graph("merge_base_octopus", f"{_REACH}, {_COMMON.format('1, 2, 3', 3)}")  # 2.5.16
def _(spark, sf_dir):
    edges, _, reached = _walked(spark, sf_dir)
    return graph.merge_bases(edges, reached, [1, 2, 3])


@_graph("independent_tips", f"{_REACH} SELECT tip, id FROM {{tips}} t WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.id = t.id AND w.tip <> t.tip)")  # 2.5.17
def _(spark, sf_dir):
    edges, tips, reached = _walked(spark, sf_dir)
    return graph.independent(edges, reached, tips)


@_graph("refs_contained", f"{_REACH} SELECT DISTINCT r.name FROM {{refs}} r JOIN walk w ON r.id = w.id WHERE w.tip = 1")  # 2.5.13
def _(spark, sf_dir):
    reached = _walked(spark, sf_dir)[2].where("tip = 1").select("id")
    return P.table(spark, sf_dir, "refs").join(reached, "id", "left_semi").select("name")


@_graph("ancestor_test", f"{_REACH} SELECT t.tip, EXISTS (SELECT 1 FROM walk w WHERE w.id = t.id AND w.tip = 1) AS is_ancestor FROM {{tips}} t")  # 2.5.12
def _(spark, sf_dir):
    _, tips, reached = _walked(spark, sf_dir)
    one = reached.where("tip = 1").select("id", F.lit(True).alias("hit"))
    return tips.join(one, "id", "left").select("tip", F.coalesce("hit", F.lit(False)).alias("is_ancestor"))


@_graph("boundary_commits", f"{_REACH}, s AS {_A_NOT_B} SELECT DISTINCT e.parent AS id FROM {{edges}} e JOIN s ON e.child = s.id WHERE e.parent NOT IN (SELECT id FROM s)")  # 2.5.28
def _(spark, sf_dir):
    edges, _, reached = _walked(spark, sf_dir)
    return graph.boundary(edges, graph.difference(reached, [1], [2]))


@_graph("ancestor_depths", "WITH RECURSIVE walk AS (SELECT tip, id, 0::BIGINT AS depth FROM {tips} UNION SELECT w.tip, e.parent, w.depth + 1 FROM walk w JOIN {edges} e ON w.id = e.child) SELECT tip, id, min(depth) AS depth FROM walk GROUP BY tip, id")  # 2.5.20
def _(spark, sf_dir):
    return _walked(spark, sf_dir)[2]


@_graph("first_parent_chain", "WITH RECURSIVE walk AS (SELECT tip, id, 0::BIGINT AS depth FROM {tips} UNION SELECT w.tip, e.parent, w.depth + 1 FROM walk w JOIN {edges} e ON w.id = e.child AND e.ord = 0) SELECT tip, id, depth FROM walk")  # 2.7.9
def _(spark, sf_dir):
    return graph.closure(P.table(spark, sf_dir, "edges"), P.table(spark, sf_dir, "tips"), first_parent=True)


@_graph("generation_numbers", "WITH RECURSIVE g AS (SELECT id, 1::BIGINT AS generation FROM {commits} WHERE id NOT IN (SELECT child FROM {edges}) UNION SELECT e.child, g.generation + 1 FROM g JOIN {edges} e ON e.parent = g.id) SELECT id, max(generation) AS generation FROM g GROUP BY id")  # 2.6.18
def _(spark, sf_dir):
    return graph.generations(P.table(spark, sf_dir, "edges"), P.table(spark, sf_dir, "commits"))


@_graph("bisect", f"{_REACH}, s AS (SELECT DISTINCT id FROM walk WHERE tip = 1), r AS (SELECT id AS top, id FROM s UNION SELECT r.top, e.parent FROM r JOIN {{edges}} e ON r.id = e.child JOIN s ON e.parent = s.id) SELECT top AS id, count(*) AS weight, least(count(*), (SELECT count(*) FROM s) - count(*)) AS distance FROM r GROUP BY top")  # 2.5.26
def _(spark, sf_dir):
    edges, _, reached = _walked(spark, sf_dir)
    return graph.bisect_weights(edges, reached.where("tip = 1").select("id"))


def _numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.4, 2.13.1: added and deleted lines between consecutive documents of a source and language."""
    from pyspark.sql import Window

    docs = P.base(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    pairs = docs.withColumn("old", F.lag("text").over(Window.partitionBy("source", "lang").orderBy("doc_id"))).where("old is not null")
    return pairs.select("doc_id", text_diff.edit_script("old", "text").alias("script")).select("doc_id", *text_diff.numstat(F.col("script")))


def _reflog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14: counts by type over the reflog read as a stream (complete mode, so the last window is not withheld)."""
    schema = P.base(spark, sf_dir, "events").schema
    name = "reflog_stream_" + uuid.uuid4().hex
    counts = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


QUERIES["numstat"] = _numstat  # no SQL for an edit script: tested against a longest-common-subsequence brute force
QUERIES["reflog_stream"] = _reflog_stream
ORACLE_SQL["reflog_stream"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"

from . import more  # noqa: E402

QUERIES |= more.QUERIES
ORACLE_SQL |= more.ORACLE_SQL
