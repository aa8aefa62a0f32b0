"""Tool-call linking for chat transcripts, in DataFrame operations only.

``link_tool_calls`` hash-joins calls and results by (conversation, identifier),
orders the calls of a conversation topologically, validates their arguments
against schemas and serialises each call as canonical JSON (sorted keys, no
spaces, non-ASCII kept).

The order is the depth of a call in the forest that ``after`` (the identifier of
the call it depends on) spans.  It is found by pointer doubling: each round joins
every call with the call its pointer has reached, so a chain of n calls takes
log2(n) rounds, and one conversation with a third of all turns is spread by
identifier and never met in one task.

Defined results: of rows that repeat an identifier the one with the smallest
(turn, name, arguments) stands, and ``copies`` counts them; a call without result
has status ``open``; a result without call makes a row of status ``orphan``; a
call whose ``after`` is unknown or null is a root (depth 0); a call on or behind
a cycle has depth null and status ``cyclic``; null identifiers link with nothing
and are left out; null or empty arguments are the empty object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Kinds of arguments a schema may ask for, as patterns of the raw JSON value.
KINDS = {
    "string": r'^".*"$',
    "integer": r"^-?\d+$",
    "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$",
    "boolean": r"^(true|false)$",
}


def json_string(text: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped, everything else as it is."""
    out = F.regexp_replace(text, r"([\\\"])", r"\\$1")
    for raw, escaped in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\b", r"\\b"), ("\f", r"\\f")):
        out = F.regexp_replace(out, raw if raw != "\b" else "\\x08", escaped)
    for code in (*range(0x08), 0x0B, *range(0x0E, 0x20)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_object(entries: Column) -> Column:
    """Canonical JSON of a map of keys to raw JSON values: keys by code point."""
    pairs = F.array_sort(F.map_entries(entries))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): pointer doubling over ``after``."""
    known = calls.select("conv_id", F.col("call_id").alias("after"))
    state = calls.select("conv_id", "call_id", "after").join(known.withColumn("_there", F.lit(True)), ["conv_id", "after"], "left")
    state = stored(state.select("conv_id", "call_id", F.when(F.col("_there"), F.col("after")).alias("up"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("depth")), "depths")
    n = state.count()
    rounds = 0
    # after k rounds a pointer has jumped 2^k calls; what still points then is on or behind a cycle
    while (1 << rounds) <= max(1, n) and not state.where("up is not null").isEmpty():
        ahead = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        state = stored(state.join(ahead, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "depths")
        rounds += 1
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``error``: null if the arguments (map of raw JSON) fit the schema of ``name``.

    ``schemas`` (name, key, kind, required) is a table of tool definitions; they
    are folded to one small row a tool and joined by name.
    """
    folded = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "required"))).alias("_fields"))
    kind = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    rows = calls.join(folded, "name", "left")
    missing = F.filter("_fields", lambda f: f["required"] & ~F.map_contains_key("arguments", f["key"]))
    wrong = F.filter("_fields", lambda f: F.map_contains_key("arguments", f["key"]) & ~F.coalesce(F.regexp_like(F.element_at("arguments", f["key"]), F.element_at(kind, f["kind"])), F.lit(False)))
    extra = F.array_sort(F.array_except(F.map_keys("arguments"), F.transform("_fields", lambda f: f["key"])))
    first = F.when(F.col("_fields").isNull(), F.lit("unknown tool"))
    first = first.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.element_at(F.transform(missing, lambda f: f["key"]), 1)))
    first = first.when(F.size(wrong) > 0, F.concat(F.lit("not a "), F.element_at(F.transform(wrong, lambda f: f["kind"]), 1), F.lit(": "), F.element_at(F.transform(wrong, lambda f: f["key"]), 1)))
    first = first.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.element_at(extra, 1)))
    return rows.withColumn("error", first).drop("_fields")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call, and one an orphan result.

    ``calls``: conv_id, call_id, turn, name, arguments (map of keys to raw JSON),
    after.  ``results``: conv_id, call_id, turn, content.  Returns conv_id,
    call_id, turn, depth, name, status, error, copies, result_turn, json.
    """
    empty = F.create_map().cast("map<string,string>")
    calls = calls.where("conv_id is not null and call_id is not null").withColumn("arguments", F.coalesce("arguments", empty))
    shown = calls.withColumn("_args", F.transform(F.array_sort(F.map_entries("arguments")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    one = shown.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "_args", "after")).alias("c"), F.count(F.lit(1)).alias("copies"))
    one = one.select("conv_id", "call_id", "copies", "c.turn", "c.name", F.map_from_entries("c._args").alias("arguments"), "c.after")
    answers = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    answers = answers.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("_answered"))
    checked = validate(one, schemas).join(_depths(one), ["conv_id", "call_id"], "left")
    rows = checked.withColumn("_called", F.lit(True)).join(answers, ["conv_id", "call_id"], "full_outer")
    status = F.when(F.col("_called").isNull(), "orphan").when(F.col("depth").isNull(), "cyclic").when(F.col("_answered").isNull(), "open").otherwise("linked")
    rows = rows.withColumn("status", status)
    null = F.lit("null")
    # canonical: keys in code point order
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical_object(F.col("arguments")), null),
        F.lit(',"content":'), F.coalesce(json_string(F.col("content")), null),
        F.lit(',"id":'), json_string(F.col("call_id")),
        F.lit(',"name":'), F.coalesce(json_string(F.col("name")), null),
        F.lit(',"status":'), json_string(F.col("status")),
        F.lit("}"),
    )
    return rows.select("conv_id", "call_id", "turn", F.col("depth"), "name", "status", "error", "copies", "result_turn", text.alias("json"))


#: Tools that the turns of a plain transcript stand for.
TURN_SCHEMAS = [("ask", "n_chars", "integer", True), ("ask", "prompt", "string", True), ("instruct", "prompt", "string", True)]


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, schemas) of a transcript without tool calls of its own.

    Each user or system turn is a call named by its role (``ask``, ``instruct``),
    identified by its turn and run after the call two turns before.  Each assistant turn is the result of the turn before it.
    A turn with any other role (``tool``) is a call named ``role:tool``, one without a role a call without name, both run
    after the turn before; no schema knows them, so their error is ``unknown tool``.
    """
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    user = F.col("role") == "user"
    prompt = json_string(F.coalesce("text", F.lit("")))
    arguments = F.when(user, F.create_map(F.lit("n_chars"), F.char_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("prompt"), prompt)).otherwise(F.create_map(F.lit("prompt"), prompt))
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    named = F.when(user, "ask").when(F.col("role") == "system", "instruct").otherwise(F.concat(F.lit("role:"), F.col("role")))
    calls = t.where(~F.col("role").eqNullSafe("assistant")).select("conv_id", name(F.col("turn")).alias("call_id"), "turn", named.alias("name"), arguments.alias("arguments"), name(F.col("turn") - F.when(user, 2).otherwise(1)).alias("after"))
    results = t.where(F.col("role") == "assistant").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = conversations.sparkSession.createDataFrame(TURN_SCHEMAS, "name string, key string, kind string, required boolean")
    return calls, results, schemas
