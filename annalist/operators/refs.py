"""Tracking branches and updates of refs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def upstreams(config: DataFrame) -> DataFrame:
    """(branch, upstream): from config (key, value, ord; the last value of a key holds, of fetch rules the first that maps the name).

    ``branch.<b>.remote`` and ``branch.<b>.merge`` name a ref of the remote, a rule ``[+]<from>:<to>`` of ``remote.<r>.fetch``
    (one star a side, or none) maps it; the remote ``.`` is the repository itself.  Null where no rule maps the name.
    """
    key = lambda i, kind: F.regexp_extract("key", rf"(?s)^{kind}\.(.*)\.([a-z]+)$", i)
    at = F.col("ord")
    own = config.select(key(1, "branch").alias("branch"), key(2, "branch").alias("what"), "value", at).where("what in ('remote', 'merge')")
    own = own.groupBy("branch").agg(*(F.max_by(F.when(F.col("what") == w, F.col("value")), F.when(F.col("what") == w, at)).alias(w) for w in ("remote", "merge")))
    own = own.where("remote is not null and merge is not null")
    rule = F.regexp_replace("value", r"^\+", "")
    rules = config.select(key(1, "remote").alias("remote"), key(2, "remote").alias("what"), F.split(rule, ":").alias("sides"), at).where("what = 'fetch' and size(sides) = 2")
    rules = rules.select("remote", F.get("sides", F.lit(0)).alias("from"), F.get("sides", F.lit(1)).alias("to"), at)
    star, head, tail = F.contains("from", F.lit("*")), F.substring_index("from", "*", 1), F.substring_index("from", "*", -1)
    fits = F.when(star, F.startswith("merge", head) & F.endswith("merge", tail) & (F.length("merge") >= F.length("from") - 1)).otherwise(F.col("merge") == F.col("from"))
    middle = F.substr("merge", F.length(head) + 1, F.length("merge") - F.length("from") + 1)
    name = F.when(star, F.concat(F.substring_index("to", "*", 1), middle, F.substring_index("to", "*", -1))).otherwise(F.col("to"))
    mapped = own.join(rules, "remote").where(fits).groupBy("branch").agg(F.min_by(name, at).alias("to"))
    found = own.join(mapped, "branch", "left")
    return found.select("branch", F.when(F.col("remote") == ".", F.col("merge")).otherwise(F.col("to")).alias("upstream"))


def update_kinds(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (name, old, new) with kind: create, delete, same, forward (new holds old) or forced."""
    tips = updates.where("old <> new").select(F.col("new").alias("tip"), F.col("new").alias("id")).distinct()
    held = graph.closure(edges, tips).select(F.col("tip").alias("new"), F.col("id").alias("old"), F.lit(True).alias("held"))
    kind = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "same").when(F.col("held"), "forward").otherwise("forced")
    return updates.join(held, ["new", "old"], "left").select("name", "old", "new", kind.alias("kind"))
