"""Queries over the compilers and history operators.  Their SQL twins are other formulations, not the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import dates, format, messages, pattern, text_diff
from annalist.operators import graph, history, refs, trees

from . import projection as P

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_REACH = "WITH RECURSIVE walk AS (SELECT tip, id FROM {tips} UNION SELECT w.tip, e.parent FROM walk w JOIN {edges} e ON w.id = e.child)"
_SECONDS = "(day - DATE '1970-01-01') * 86400 + id % 86400"


def _query(duck: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if duck:
            ORACLE_SQL[f.__name__] = P.duck(duck)
        return f

    return register


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "commits")
    return rows.withColumn("seconds", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.col("id") % 86400)


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).withColumn("time", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "trees").select("path").distinct()


# --- patterns: 2.4.15 to 2.4.17, 2.4.19, 2.4.28, 2.4.29, 2.10.20 --------------------------------


@_query("SELECT DISTINCT path FROM {trees} WHERE (regexp_full_match(lower(path), 'brand#1./promo.*') OR regexp_full_match(path, 'Brand#2[1-3]/.*/1') OR path LIKE 'Brand#55/%') AND path NOT LIKE '%COPPER%'")
def pathspec_magic(spark, sf_dir):
    return _paths(spark, sf_dir).where(pattern.pathspec([":(icase)brand#1?/promo*", "Brand#2[1-3]/*/1", ":(literal)Brand#55", ":!*COPPER*"], F.col("path")))


@_query("SELECT DISTINCT path FROM {trees} WHERE regexp_full_match(path, 'Brand#[^/]*/[^/]*/[12]')")
def pathspec_glob(spark, sf_dir):
    return _paths(spark, sf_dir).where(pattern.pathspec([":(glob)Brand#*/*/[12]"], F.col("path")))


@_query("SELECT DISTINCT path FROM {trees} WHERE (path LIKE 'Brand#1%' AND path NOT LIKE 'Brand#11/%') OR path LIKE 'Brand#21/STANDARD%' OR path LIKE '%/7'")
def ignore_rules(spark, sf_dir):
    return _paths(spark, sf_dir).where(pattern.ignored(["# a comment", "Brand#1*/", "!Brand#11/", "/Brand#21/STANDARD*", "**/7"], F.col("path")))


@_query("SELECT name FROM {refs} WHERE regexp_full_match(name, 'refs/heads/1[^/]*') OR regexp_full_match(name, 'refs/tags/v[12].') OR name = 'refs/heads/25'")
def refname_globs(spark, sf_dir):
    return P.table(spark, sf_dir, "refs").where(pattern.refname(["refs/heads/1*", "refs/tags/v[12]?", "refs/heads/25/"], F.col("name"))).select("name")


# --- dates: 2.11.1, 2.11.2, 2.11.6 -----------------------------------------------------------


@_query(f"""
SELECT id, strftime(t, '%Y-%m-%d') AS short, strftime(t, '%Y-%m-%d %H:%M:%S') || ' -0230' AS iso, strftime(t, '%Y-%m-%dT%H:%M:%S') || '-02:30' AS strict,
  strftime(t, '%a, %-d %b %Y %H:%M:%S') || ' -0230' AS rfc, strftime(t, '%a %b %-d %H:%M:%S %Y') || ' -0230' AS plain, seconds::VARCHAR || ' -0230' AS raw
FROM (SELECT id, seconds, make_timestamp((seconds - 9000) * 1000000) AS t FROM (SELECT id, {_SECONDS} AS seconds FROM {{commits}}) a) b""")
def date_modes(spark, sf_dir):
    show = lambda mode: dates.render(F.col("seconds"), F.lit(-150), mode)
    return _commits(spark, sf_dir).select("id", show("short").alias("short"), show("iso").alias("iso"), show("iso-strict").alias("strict"), show("rfc").alias("rfc"), show("default").alias("plain"), show("raw").alias("raw"))


@_query(f"SELECT id FROM {{commits}} WHERE {_SECONDS} BETWEEN epoch(TIMESTAMP '1995-03-01 00:00:00') AND epoch(TIMESTAMP '1995-03-31 12:00:00')")
def date_window_parsed(spark, sf_dir):
    """2.4.1, 2.4.2, 2.11.3, 2.11.4: since and until are read as the plan is built."""
    until = dates.parse("31 Mar 1995 12:00:00 +0000")[0]
    since = dates.approximate("1995-03-01 00:00:00", until)
    return _commits(spark, sf_dir).where(F.col("seconds").between(since, until)).select("id")


# --- formats: 2.3.1 to 2.3.6, 2.3.9, 2.3.10, 2.3.16, 2.3.18, 2.10.1 to 2.10.6 --------------------


@_query("""
SELECT id, substr(oid, 1, 7) || ' ' || CASE WHEN length(n) > 12 THEN substr(n, 1, 10) || '..' ELSE rpad(n, 12, ' ') END || '<' || author || '> ' || message || chr(10)
  || trim(regexp_replace(message, '[^A-Za-z0-9._]+', '-', 'g'), '-') || ' A%' AS line
FROM (SELECT *, 'the author ' || author AS n FROM {commits}) c""")
def log_pretty(spark, sf_dir):
    author = F.col("author").cast("string")
    fields: dict[str, Column] = {"oid": F.col("oid"), "author_name": F.concat(F.lit("the author "), author), "author_email": F.concat(author, F.lit("@example.com")), "message": F.col("message")}
    return _commits(spark, sf_dir).select("id", format.compile_log("%h %<(12,trunc)%an<%al> %s%n%f %x41%%", fields).alias("line"))


@_query("SELECT name, CASE WHEN name LIKE 'refs/tags/%' THEN rpad(substr(name, 11), 12, ' ') ELSE lpad(substr(name, 12), 12, ' ') END || '|' || split_part(name, '/', 2) || '|' || substr(sha1(name), 1, 9) AS line FROM {refs}")
def ref_pretty(spark, sf_dir):
    fields = {"refname": F.col("name"), "objectname": F.sha1("name")}
    text = "%(if:equals=tags)%(refname:rstrip=-2)%(then)%(end)%(if:equals=refs/tags)%(refname:rstrip=1)%(then)%(align:12,left)%(refname:short)%(end)%(else)%(align:12,right)%(refname:short)%(end)%(end)|%(if)%(refname)%(then)%(refname:lstrip=1)%(end)"
    line = F.regexp_replace(format.compile_ref(text, fields), "/[^/]*$", "")
    return P.table(spark, sf_dir, "refs").select("name", F.concat(line, F.lit("|"), format.compile_ref("%(objectname:short=9)", fields)).alias("line"))


@_query("SELECT id, 'Reviewed-by' AS key, 'user ' || author AS value FROM {commits} UNION ALL SELECT id, 'Fixes' AS key, '#' || author || ' and more' AS value FROM {commits}")
def trailer_rows(spark, sf_dir):
    """2.10.8, 2.6.16."""
    author = F.col("author").cast("string")
    text = F.concat(F.col("message"), F.lit("\n\nA paragraph: not a trailer here.\n\nReviewed-by: user "), author, F.lit("\nFixes: #"), author, F.lit("\n and more\n"))
    return _commits(spark, sf_dir).select("id", F.explode(messages.trailers(text)).alias("t")).select("id", "t.key", "t.value")


@_query(f"SELECT id, 'user ' || author AS name, author || '@example.com' AS email, {_SECONDS} AS seconds, -570::INT AS minutes FROM {{commits}}")
def identity_parts(spark, sf_dir):
    """2.10.6, 2.11.7."""
    raw = F.concat(F.lit("user "), F.col("author").cast("string"), F.lit(" <"), F.col("author").cast("string"), F.lit("@example.com> "), F.col("seconds").cast("string"), F.lit(" -0930"))
    return _commits(spark, sf_dir).select("id", messages.identity(raw).alias("i")).select("id", "i.name", "i.email", "i.seconds", F.col("i.offset").alias("minutes"))


# --- names and values: 2.3.21, 2.6.3, 2.7.8, 2.10.17, 2.10.22, 2.12.9, 2.12.10 -------------------


@_query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 12) AS rank FROM part")
def version_rank(spark, sf_dir):
    from pyspark.sql import Window

    name = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"))
    order = Window.partitionBy("p_brand").orderBy(messages.version_key(name))
    return P.base(spark, sf_dir, "part").select("p_partkey", F.dense_rank().over(order).alias("rank"))


@_query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT * 1024 WHEN 1 THEN p_size::BIGINT * 1048576 WHEN 2 THEN p_size::BIGINT END AS bytes, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size <> 0 END AS flag FROM part")
def size_values(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("k"), F.lit("M"), F.lit(""), F.lit("q")), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), unit)
    return P.base(spark, sf_dir, "part").select("p_partkey", messages.size_value(text).alias("bytes"), messages.bool_value(text).alias("flag"))


@_query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '"' || p_type || '\t\303\251\"' || '"' ELSE p_type END AS quoted FROM part""")
def path_quotes(spark, sf_dir):
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_type"), F.lit('\té"'))).otherwise(F.col("p_type"))
    return P.base(spark, sf_dir, "part").select("p_partkey", messages.quoted_path(path).alias("quoted"))


@_query("SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'near:' || substr(url, 13) WHEN starts_with(url, 'https://') THEN 'far:' || substr(url, 9) ELSE url END AS url FROM pages")
def url_instead_of(spark, sf_dir):
    return P.base(spark, sf_dir, "pages").select("page_id", messages.rewritten_url(F.col("url"), [("https://", "far:"), ("https://www.", "near:"), ("ssh://", "far:")]).alias("url"))


# --- orders: 2.8.1 to 2.8.4, 2.8.7, 2.8.15 -----------------------------------------------------


@_query("SELECT id, row_number() OVER (ORDER BY day DESC, id DESC) AS rank FROM {commits}")
def date_order(spark, sf_dir):
    return history.ordered(_dated(spark, sf_dir).select("id", "time"), P.table(spark, sf_dir, "edges"))


@_query()
def topo_order(spark, sf_dir):
    """2.8.3; no SQL for it: tested against a plain walk."""
    return history.ordered(_dated(spark, sf_dir).select("id", "time"), P.table(spark, sf_dir, "edges"), "topo")


@_query("SELECT id, CAST(day AS STRING) AS day FROM (SELECT id, day, row_number() OVER (ORDER BY day DESC, id DESC) AS r FROM {commits}) t WHERE r BETWEEN 11 AND 30")
def skip_and_count(spark, sf_dir):
    return _commits(spark, sf_dir).orderBy(F.desc("day"), F.desc("id")).offset(10).limit(20).select("id", F.col("day").cast("string").alias("day"))


# --- graph: 2.5.4, 2.5.6, 2.5.7, 2.5.13, 2.5.21, 2.5.23, 2.5.53, 2.2.9, 2.2.10, 2.6.10 -----------


def _walked(spark, sf_dir):
    edges, tips = graph.stored_edges(P.table(spark, sf_dir, "edges")), P.table(spark, sf_dir, "tips")
    return edges, tips, graph.closure(edges, tips)


@_query(f"{_REACH} SELECT w.tip, c.id, c.message FROM walk w JOIN {{commits}} c ON c.id = w.id")
def commit_walk_bodies(spark, sf_dir):
    return _walked(spark, sf_dir)[2].join(_commits(spark, sf_dir), "id").select("tip", "id", "message")


@_query(f"{_REACH} SELECT DISTINCT oid, 'commit' AS type FROM {{commits}} WHERE id IN (SELECT id FROM walk) UNION ALL SELECT DISTINCT oid, 'blob' AS type FROM {{trees}} WHERE commit_id IN (SELECT id FROM walk)")
def object_closure(spark, sf_dir):
    return history.object_closure(_walked(spark, sf_dir)[2], _commits(spark, sf_dir), P.table(spark, sf_dir, "trees"))


@_query(f"{_REACH}, o AS (SELECT w.tip, c.oid, 'commit' AS type FROM walk w JOIN {{commits}} c ON c.id = w.id UNION ALL SELECT w.tip, t.oid, 'blob' FROM walk w JOIN {{trees}} t ON t.commit_id = w.id) SELECT oid, type FROM o WHERE tip = 1 EXCEPT SELECT oid, type FROM o WHERE tip = 2")
def object_closure_cut(spark, sf_dir):
    reached = _walked(spark, sf_dir)[2]
    return history.object_closure(reached.where("tip = 1"), _commits(spark, sf_dir), P.table(spark, sf_dir, "trees"), reached.where("tip = 2"))


@_query(f"{_REACH} SELECT name FROM {{refs}} WHERE id NOT IN (SELECT id FROM walk WHERE tip = 1)")
def refs_not_contained(spark, sf_dir):
    reached = _walked(spark, sf_dir)[2].where("tip = 1").select("id")
    return P.table(spark, sf_dir, "refs").join(reached, "id", "left_anti").select("name")


@_query(f"""{_REACH}, c AS (SELECT id FROM walk WHERE tip IN (1, 2) GROUP BY id HAVING count(DISTINCT tip) = 2), b AS (SELECT id FROM c WHERE id NOT IN (SELECT e.parent FROM {{edges}} e JOIN c ON e.child = c.id)),
up AS (SELECT id AS bottom, id FROM b UNION SELECT up.bottom, e.child FROM up JOIN {{edges}} e ON e.parent = up.id)
SELECT tip, id FROM walk WHERE tip IN (1, 2) AND id IN (SELECT id FROM up WHERE id <> bottom) AND id NOT IN (SELECT id FROM b)""")
def ancestry_path(spark, sf_dir):
    edges, _, reached = _walked(spark, sf_dir)
    return history.ancestry_path(edges, reached.where("tip in (1, 2)"), graph.merge_bases(edges, reached, [1, 2]).select("id"))


@_query(f"""{_REACH}, c AS (SELECT w.tip, r.id, r.name, row_number() OVER (PARTITION BY w.tip ORDER BY k.day DESC, k.id DESC) AS i FROM walk w JOIN {{refs}} r ON r.id = w.id JOIN {{commits}} k ON k.id = r.id WHERE r.name LIKE 'refs/tags/%'),
held AS (SELECT id AS tag, id FROM (SELECT DISTINCT id FROM c WHERE i <= 10) s UNION SELECT h.tag, e.parent FROM held h JOIN {{edges}} e ON h.id = e.child),
d AS (SELECT c.tip, c.name, c.i, (SELECT count(*) FROM walk w LEFT JOIN held h ON h.tag = c.id AND h.id = w.id WHERE w.tip = c.tip AND h.id IS NULL) AS depth FROM c WHERE i <= 10),
n AS (SELECT *, row_number() OVER (PARTITION BY tip ORDER BY depth, i) AS k FROM d)
SELECT t.tip, n.name AS tag, n.depth FROM {{tips}} t LEFT JOIN n ON n.tip = t.tip AND n.k = 1""")
def describe(spark, sf_dir):
    edges, tips = graph.stored_edges(P.table(spark, sf_dir, "edges")), P.table(spark, sf_dir, "tips")
    tags = P.table(spark, sf_dir, "refs").where("name like 'refs/tags/%'").join(_dated(spark, sf_dir).select("id", "time"), "id")
    return history.describe(edges, tips, tags)


@_query("""SELECT path, max_by(id, concat(CAST(day AS STRING), lpad(CAST(id AS STRING), 20, '0'))) AS commit_id FROM (
  SELECT DISTINCT t.path, c.id, c.day FROM {trees} t JOIN {commits} c ON c.id = t.commit_id WHERE NOT EXISTS (
    SELECT 1 FROM {edges} e JOIN {trees} b ON b.commit_id = e.parent WHERE e.child = t.commit_id AND e.ord = 0 AND b.path = t.path AND b.oid = t.oid)) s GROUP BY path""")
def last_changed(spark, sf_dir):
    return history.last_changed(P.table(spark, sf_dir, "trees"), _dated(spark, sf_dir).select("id", "time"), P.table(spark, sf_dir, "edges"))


@_query("WITH RECURSIVE walk AS (SELECT id FROM {refs} WHERE name LIKE 'refs/tags/%' UNION SELECT e.parent FROM walk w JOIN {edges} e ON w.id = e.child) SELECT id FROM {commits} WHERE id NOT IN (SELECT id FROM walk)")
def unreachable_from_tags(spark, sf_dir):
    roots = P.table(spark, sf_dir, "refs").where("name like 'refs/tags/%'").select("id")
    return history.unreachable(_commits(spark, sf_dir), P.table(spark, sf_dir, "edges"), roots).select("id")


# --- sets of tips and names: 2.5.15, 2.5.63, 2.9.1, 2.9.5 ---------------------------------------


@_query(f"{_REACH} SELECT DISTINCT id FROM walk")
def tips_union(spark, sf_dir):
    return _walked(spark, sf_dir)[2].select("id").distinct()


@_query(f"{_REACH} SELECT id FROM walk WHERE tip = 1 INTERSECT SELECT id FROM walk WHERE tip = 2 INTERSECT SELECT id FROM walk WHERE tip = 3")
def tips_intersection(spark, sf_dir):
    found = _walked(spark, sf_dir)[2].where("tip in (1, 2, 3)").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return found.where("n = 3").select("id")


@_query(f"""{_REACH}, c AS (SELECT DISTINCT id FROM walk WHERE tip = 1 AND id IN (SELECT id FROM walk WHERE tip IN (2, 3))),
low AS (SELECT c.id AS top, c.id FROM c UNION SELECT low.top, e.parent FROM low JOIN {{edges}} e ON e.child = low.id)
SELECT id FROM c WHERE id NOT IN (SELECT id FROM low WHERE id <> top)""")
def merge_base_many(spark, sf_dir):
    """Best common ancestors of one tip and a merge that would be made of two others."""
    edges, _, reached = _walked(spark, sf_dir)
    return graph.merge_bases_with(edges, reached, 1, [2, 3])


@_query("""WITH n AS (SELECT name FROM {refs} UNION SELECT name || '/wip/a' FROM {refs} WHERE id % 3 = 0 UNION SELECT name || '/wip' FROM {refs} WHERE id % 6 = 0)
SELECT a.name AS file, b.name AS below FROM n a JOIN n b ON split_part(a.name, '/', 3) = split_part(b.name, '/', 3) AND starts_with(b.name, a.name || '/')""")
def ref_path_conflicts(spark, sf_dir):
    """Names that are a directory of another name: each name meets its own prefixes by an equi-join."""
    refs = P.table(spark, sf_dir, "refs")
    deep = refs.where("id % 3 = 0").select(F.concat("name", F.lit("/wip/a")).alias("name"))
    names = refs.select("name").unionByName(deep).unionByName(refs.where("id % 6 = 0").select(F.concat("name", F.lit("/wip")).alias("name"))).distinct()
    cuts = F.expr("transform(sequence(1, size(split(name, '/')) - 1), i -> substring_index(name, '/', i))")
    above = names.where("name like '%/%'").select(F.col("name").alias("below"), F.explode(cuts).alias("name"))
    return names.join(above, "name").select(F.col("name").alias("file"), "below")


# --- texts and paths: 2.4.32, 2.10.13, 2.10.18 --------------------------------------------------


@_query("SELECT DISTINCT path FROM {trees} WHERE path LIKE 'Brand#1%' AND split_part(path, '/', 3) = '' UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM {trees} WHERE path LIKE 'Brand#1%'")
def paths_to_depth(spark, sf_dir):
    """Files and directories at most one level below the directories that a pathspec names; deeper paths fold into theirs."""
    found = _paths(spark, sf_dir).where(pattern.pathspec(["Brand#1*"], F.col("path")))
    return found.select(F.substring_index("path", "/", 2).alias("path")).distinct()


@_query("SELECT d.doc_id, l.text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(rtrim(line, ' ' || chr(9)), chr(10) ORDER BY n) AS text FROM {lines} GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def whitespace_fixed(spark, sf_dir):
    return P.base(spark, sf_dir, "documents").select("doc_id", messages.without_trailing_blanks("text").alias("text"))


@_query("""SELECT h.doc_id, h.n, arg_max(f.line, f.n) AS heading FROM {lines} h LEFT JOIN {lines} f ON f.doc_id = h.doc_id AND f.n < h.n AND regexp_matches(f.line, '^[A-Za-z_$]')
WHERE contains(h.line, 'License') GROUP BY h.doc_id, h.n""")
def hunk_headings(spark, sf_dir):
    """For each hit the last line above it that begins like a definition."""
    from pyspark.sql import Window

    above = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = P.table(spark, sf_dir, "lines")
    has = rows.where(F.contains("line", F.lit("License"))).select("doc_id").distinct()
    begun = F.when(F.col("line").rlike("^[A-Za-z_$]"), F.col("line"))
    seen = rows.join(has, "doc_id", "left_semi").withColumn("heading", F.last(begun, ignorenulls=True).over(above))
    return seen.where(F.contains("line", F.lit("License"))).select("doc_id", "n", "heading")


# --- content: 2.5.32, 2.5.40, 2.5.43, 2.5.54, 2.13.2, 2.13.4, 2.13.7 -------------------------------


@_query("""WITH c AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l GROUP BY doc_id, line),
s AS (SELECT doc_id, strlen(text) AS size FROM documents),
p AS (SELECT a.doc_id AS old, b.doc_id AS new, sum(least(a.n, b.n) * (strlen(a.line) + 1)) AS same FROM c a JOIN c b ON a.line = b.line WHERE a.doc_id % 7 = 3 AND b.doc_id % 7 = 1 GROUP BY ALL),
f AS (SELECT p.old, p.new, floor(p.same * 100 / greatest(x.size + 1, y.size + 1))::INT AS score FROM p JOIN s x ON x.doc_id = p.old JOIN s y ON y.doc_id = p.new WHERE least(x.size, y.size) * 100 >= greatest(x.size, y.size) * 50)
SELECT old, new, score FROM (SELECT *, row_number() OVER (PARTITION BY new ORDER BY score DESC, old) AS r FROM f WHERE score >= 50) t WHERE r = 1""")
def inexact_rename(spark, sf_dir):
    docs = P.base(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return history.renames(docs.where("path % 7 = 3"), docs.where("path % 7 = 1"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.base(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old")), "doc_id")


@_query()
def histogram_stat(spark, sf_dir):
    """Added and deleted lines against the document before, by histogram diff; property tests in tests/test_text_diff.py."""
    return _pairs(spark, sf_dir).select("doc_id", *text_diff.numstat(text_diff.edit_script("old", "text", "histogram")))


@_query()
def patch_ids(spark, sf_dir):
    """Patch id of each document's diff from the one before; tests as above."""
    return _pairs(spark, sf_dir).select("doc_id", text_diff.patch_ids("old", "text").alias("patch_id"))


@_query()
def text_merge(spark, sf_dir):
    """A line added in front on one side, the last line dropped on the other, merged; laws in tests/test_text_diff.py."""
    docs = P.base(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.withColumns({"ours": F.concat(F.lit("first\n"), "text"), "theirs": F.regexp_replace("text", r"\n[^\n]*\z", "")})
    return both.select("doc_id", text_diff.merged("text", "ours", "theirs").alias("m")).select("doc_id", "m.text", "m.conflicts")


@_query()
def blame_threads(spark, sf_dir):
    """For each line of a conversation's last turn, the turn since which it stands; tested on hand-made versions."""
    turns = P.base(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("version"), "text")
    return history.blame(turns)


# --- walks and trees: 2.5.18, 2.5.25, 2.5.29, 2.5.30, 2.5.68, 2.5.58, 2.5.60, 2.5.47, 2.5.48 ----------


@_query(f"""{_REACH}, past AS (SELECT id FROM {{commits}} WHERE author IN (SELECT c.author FROM {{commits}} c JOIN {{tips}} t ON t.id = c.id WHERE t.tip = 2)),
old AS (SELECT id FROM past UNION SELECT e.parent FROM old JOIN {{edges}} e ON old.id = e.child),
c AS (SELECT tip, id FROM walk WHERE id IN (SELECT id FROM old)),
best AS (SELECT tip, id, count(*) OVER (PARTITION BY tip) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM {{edges}} e JOIN c d ON e.child = d.id WHERE d.tip = c.tip AND e.parent = c.id))
SELECT tip, id FROM best WHERE n = 1 AND id IN (SELECT id FROM past)""")
def fork_point(spark, sf_dir):
    """Where each tip left the branch of tip 2, whose past values are its author's commits."""
    edges, tips = P.table(spark, sf_dir, "edges"), P.table(spark, sf_dir, "tips")
    commits = P.table(spark, sf_dir, "commits")
    author = commits.join(tips.where("tip = 2"), "id", "left_semi").select("author")
    return history.fork_points(edges, tips, commits.join(author, "author", "left_semi").select("id"))


@_query(f"""{_REACH}, c AS (SELECT id, string_agg(tip::VARCHAR, '' ORDER BY tip) AS t FROM (SELECT DISTINCT tip, id FROM walk WHERE tip <= 3) w GROUP BY id)
SELECT id, CASE t WHEN '1' THEN '+  ' WHEN '2' THEN ' + ' WHEN '3' THEN '  +' WHEN '12' THEN '++ ' WHEN '13' THEN '+ +' WHEN '23' THEN ' ++' ELSE '+++' END AS flags
FROM c WHERE id NOT IN (SELECT e.parent FROM {{edges}} e JOIN c d ON d.id = e.child WHERE d.t = '123')""")
def show_branch(spark, sf_dir):
    edges, _, reached = _walked(spark, sf_dir)
    return history.branch_flags(edges, reached, [1, 2, 3])


@_query(f"""{_REACH}, s AS (SELECT id FROM walk WHERE tip = 1 EXCEPT SELECT id FROM walk WHERE tip = 2), b AS (SELECT e.parent AS id FROM {{edges}} e JOIN s ON e.child = s.id EXCEPT SELECT id FROM s),
o AS (SELECT id, oid, 'commit' AS type FROM {{commits}} UNION ALL SELECT commit_id, oid, 'blob' FROM {{trees}})
SELECT oid, type FROM o WHERE id IN (SELECT id FROM s) EXCEPT SELECT oid, type FROM o WHERE id IN (SELECT id FROM b)""")
def objects_edge(spark, sf_dir):
    """Objects of a range without those that its boundary commits hold."""
    edges, _, reached = _walked(spark, sf_dir)
    inside = graph.difference(reached, [1], [2])
    return history.object_closure(inside, _commits(spark, sf_dir), P.table(spark, sf_dir, "trees"), graph.boundary(edges, inside))


@_query("""WITH RECURSIVE up AS (SELECT child, parent AS id FROM {edges} WHERE ord = 0 AND child IN (SELECT id FROM {refs})
  UNION SELECT up.child, e.parent FROM up JOIN {edges} e ON e.child = up.id AND e.ord = 0 WHERE up.id NOT IN (SELECT id FROM {refs}))
SELECT child, id AS parent FROM up WHERE id IN (SELECT id FROM {refs})""")
def simplified_by_decoration(spark, sf_dir):
    """Commits that a ref names, with their next such ancestor on the line of first parents."""
    return history.rewritten_parents(P.table(spark, sf_dir, "edges"), P.table(spark, sf_dir, "refs").select("id").distinct())


_TAG_PAST = "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE lag(id) OVER (PARTITION BY author ORDER BY day, id) END AS before FROM {commits} WHERE priority = '1-URGENT'"


@_query(f"""WITH RECURSIVE t AS (SELECT id, before FROM ({_TAG_PAST}) a), up AS (SELECT id, id AS at FROM t UNION SELECT up.id, t.before FROM up JOIN t ON t.id = up.at WHERE t.before IS NOT NULL)
SELECT up.id, 'commit ' || up.at AS target FROM up JOIN t ON t.id = up.at WHERE t.before IS NULL""")
def peeled_tags(spark, sf_dir):
    """Each urgent commit has a tag; two thirds of them point at the author's tag before."""
    tags = P.run(spark, sf_dir, _TAG_PAST)
    name = lambda kind, c: F.concat(F.lit(kind + " "), F.col(c).cast("string"))
    named = tags.select(name("tag", "id").alias("id"), F.coalesce(name("tag", "before"), name("commit", "id")).alias("target"))
    return history.peeled(named).select(F.substring_index("id", " ", -1).cast("long").alias("id"), "target")


@_query("""WITH a AS (SELECT r.name, r.id, min(t.path) AS file FROM {refs} r JOIN {trees} t ON t.commit_id = r.id GROUP BY r.name, r.id),
q AS (SELECT name, id, file AS path FROM a UNION ALL SELECT name, id, split_part(file, '/', 1) FROM a UNION ALL SELECT name, id, file || '/x' FROM a)
SELECT q.name, q.path, CASE WHEN count(t.path) = 0 THEN 'missing' WHEN max(t.path = q.path) THEN 'blob' ELSE 'tree' END AS type, min(CASE WHEN t.path = q.path THEN t.oid END) AS oid, count(t.path) AS entries
FROM q LEFT JOIN {trees} t ON t.commit_id = q.id AND (t.path = q.path OR starts_with(t.path, q.path || '/')) GROUP BY q.name, q.path""")
def tree_paths(spark, sf_dir):
    """ref:path for the first file of each ref's tree, its top directory, and a path below the file."""
    refs, files = P.table(spark, sf_dir, "refs"), P.table(spark, sf_dir, "trees")
    first = files.groupBy(F.col("commit_id")).agg(F.min("path").alias("file")).join(refs.withColumnRenamed("id", "commit_id"), "commit_id")
    asked = first.select("name", "commit_id", F.explode(F.array("file", F.substring_index("file", "/", 1), F.concat("file", F.lit("/x")))).alias("path"))
    return trees.resolved(asked, files).select("name", "path", "type", "oid", "entries")


@_query("""SELECT path, CASE WHEN path NOT IN (SELECT path FROM {head}) THEN 'remove' WHEN (path, oid, mode) IN (SELECT (path, oid, mode) FROM {head}) THEN 'keep' ELSE 'update' END AS action FROM {staged}
UNION ALL SELECT path, 'update' FROM {head} WHERE path NOT IN (SELECT path FROM {staged})""")
def unpack_one_way(spark, sf_dir):
    return trees.unpack_one_way(P.table(spark, sf_dir, "staged"), P.table(spark, sf_dir, "head"))


@_query("""WITH p AS (SELECT doc_id AS path FROM documents),
v AS (SELECT p.path, i.oid || i.mode AS i, h.oid || h.mode AS h, m.oid || m.mode AS m, p.path % 11 = 0 AS dirty FROM p LEFT JOIN {staged} i ON i.path = p.path LEFT JOIN {head} h ON h.path = p.path LEFT JOIN {worktree} m ON m.path = p.path)
SELECT path, 'update' AS action FROM v WHERE (i IS NULL AND h IS NULL AND m IS NOT NULL) OR (i = h AND h <> m AND NOT dirty)
UNION ALL SELECT path, 'remove' FROM v WHERE (i IS NULL AND h IS NOT NULL AND m IS NULL) OR (i = h AND m IS NULL AND NOT dirty)
UNION ALL SELECT path, 'keep' FROM v WHERE (i IS NULL AND h = m) OR (i IS NOT NULL AND (h = m OR i = m OR (h IS NULL AND m IS NULL)))
UNION ALL SELECT path, 'fail' FROM v WHERE (i IS NULL AND h <> m) OR (i = h AND dirty AND (m IS NULL OR h <> m))
  OR (i IS NOT NULL AND ((h IS NULL AND i <> m) OR (h <> i AND m IS NULL) OR (h <> i AND h <> m AND i <> m)))""")
def unpack_two_way(spark, sf_dir):
    """From head to the worktree's state through the staged entries; every eleventh file counts as changed."""
    t = lambda name: P.table(spark, sf_dir, name)
    dirty = P.base(spark, sf_dir, "documents").where("doc_id % 11 = 0").select(F.col("doc_id").alias("path"))
    return trees.unpack_two_way(t("staged"), t("head"), t("worktree"), dirty)


# --- refs and paths: 2.1.28, 2.5.22, 2.5.65, 2.5.66 ---------------------------------------------


@_query("""WITH g AS (SELECT commit_id, string_agg(path || oid || mode::VARCHAR, ';' ORDER BY path, oid, mode) AS t FROM {trees} WHERE path LIKE 'Brand#1%' GROUP BY commit_id),
k AS (SELECT c.id FROM {commits} c LEFT JOIN {edges} e ON e.child = c.id AND e.ord = 0 LEFT JOIN g a ON a.commit_id = c.id LEFT JOIN g b ON b.commit_id = e.parent WHERE coalesce(a.t, '') <> coalesce(b.t, '')),
up AS (SELECT child, parent AS id FROM {edges} WHERE ord = 0 AND child IN (SELECT id FROM k)), r AS (WITH RECURSIVE w AS (SELECT child, id FROM up UNION SELECT w.child, e.parent FROM w JOIN {edges} e ON e.child = w.id AND e.ord = 0 WHERE w.id NOT IN (SELECT id FROM k)) SELECT * FROM w)
SELECT k.id, r.id AS parent FROM k LEFT JOIN r ON r.child = k.id AND r.id IN (SELECT id FROM k)""")
def path_history(spark, sf_dir):
    """The line of first parents simplified to commits that change paths of a pathspec, with their rewritten parents."""
    files = P.table(spark, sf_dir, "trees").where(pattern.pathspec(["Brand#1*"], F.col("path")))
    edges = P.table(spark, sf_dir, "edges")
    kept = trees.changed_from_parent(files, edges, P.table(spark, sf_dir, "commits"))
    parents = history.rewritten_parents(edges, kept)
    return kept.join(parents, F.col("id") == F.col("child"), "left").select("id", "parent")


_UPDATES = """
SELECT concat('kept/', CAST(tip AS STRING)) AS name, id AS old, id AS new FROM {tips} UNION ALL SELECT concat('new/', CAST(tip AS STRING)) AS name, CAST(NULL AS BIGINT) AS old, id AS new FROM {tips}
UNION ALL SELECT concat('gone/', CAST(tip AS STRING)) AS name, id AS old, CAST(NULL AS BIGINT) AS new FROM {tips}
UNION ALL SELECT concat('next/', CAST(t.tip AS STRING), '/', CAST(e.ord AS STRING)) AS name, e.parent AS old, t.id AS new FROM {tips} t JOIN {edges} e ON e.child = t.id
UNION ALL SELECT concat('back/', CAST(t.tip AS STRING), '/', CAST(e.ord AS STRING)) AS name, t.id AS old, e.parent AS new FROM {tips} t JOIN {edges} e ON e.child = t.id"""


@_query(f"""WITH RECURSIVE u AS ({_UPDATES}), w AS (SELECT new AS tip, new AS id FROM u WHERE new IS NOT NULL UNION SELECT w.tip, e.parent FROM w JOIN {{edges}} e ON e.child = w.id)
SELECT name, old, new, CASE WHEN old IS NULL THEN 'create' WHEN new IS NULL THEN 'delete' WHEN old = new THEN 'same' WHEN EXISTS (SELECT 1 FROM w WHERE w.tip = u.new AND w.id = u.old) THEN 'forward' ELSE 'forced' END AS kind FROM u""")
def update_kinds(spark, sf_dir):
    return refs.update_kinds(P.table(spark, sf_dir, "edges"), P.run(spark, sf_dir, _UPDATES))


@_query("""SELECT c_custkey::VARCHAR AS branch, CASE c_nationkey % 3 WHEN 0 THEN 'refs/heads/' || c_mktsegment WHEN 1 THEN 'refs/remotes/origin/' || c_mktsegment || '/x' END AS upstream FROM customer""")
def upstream_refs(spark, sf_dir):
    """A branch for each customer; a third follow a local branch, a third one of origin, a third a remote without a rule for it."""
    rows = P.base(spark, sf_dir, "customer")
    key = lambda what: F.concat(F.lit("branch."), F.col("c_custkey").cast("string"), F.lit("." + what))
    kind = F.col("c_nationkey") % 3
    remote = rows.select(key("remote").alias("key"), F.when(kind == 0, ".").when(kind == 1, "origin").otherwise("other").alias("value"), F.lit(2).alias("ord"))
    merge = rows.select(key("merge").alias("key"), F.concat(F.lit("refs/heads/"), "c_mktsegment", F.when(kind == 1, "/x").otherwise("")).alias("value"), F.lit(3).alias("ord"))
    fixed = spark.createDataFrame([("remote.origin.fetch", "+refs/heads/*/x:refs/remotes/origin/*/x", 0), ("remote.origin.fetch", "refs/heads/*:refs/remotes/late/*", 1), ("remote.other.fetch", "refs/heads/main:refs/remotes/other/main", 0)], "key string, value string, ord int")
    return refs.upstreams(remote.unionByName(remote.withColumns({"value": F.lit("overridden"), "ord": F.lit(1)})).unionByName(merge).unionByName(fixed))


@_query("""WITH t AS (SELECT DISTINCT path FROM {trees}), p AS (SELECT path || '/below' AS path FROM t WHERE path LIKE '%/1' UNION SELECT regexp_extract(path, '^[^/]*/[^/]*') FROM t WHERE path LIKE 'Brand#2%' UNION SELECT path || '.new' FROM t)
SELECT path FROM p WHERE path LIKE '%/below' OR path NOT LIKE '%/%/%'""")
def killed_paths(spark, sf_dir):
    """Files below tracked files, files where tracked directories are, and new files, of which none is killed."""
    tracked = _paths(spark, sf_dir)
    present = tracked.where("path like '%/1'").select(F.concat("path", F.lit("/below")).alias("path")).unionByName(tracked.where("path like 'Brand#2%'").select(F.substring_index("path", "/", 2).alias("path")).distinct())
    return trees.killed(present.unionByName(tracked.select(F.concat("path", F.lit(".new")).alias("path"))), tracked)
