"""Compilers and columns against plain Python."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from annalist.functions import dates, format, messages, pattern

CASES = [
    ("foo", "foo", True), ("foo", "bar", False), ("*", "a/b", False), ("**", "a/b", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
    ("a/**", "a/b/c", True), ("a/**", "a", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[!a-c]x", "dx", True), ("[[:digit:]]", "7", True),
    ("[a", "[a", False), (r"\*", "*", True), (r"\*", "x", False), ("a**b", "axxb", True), ("a**b", "a/b", False), ("[]-]", "]", True), ("t[a-g]n", "ten", True), ("a.b", "axb", False),
]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_wildmatch(spark):
    for glob, name, want in CASES:
        assert one(spark, F.lit(name).rlike(pattern.wildmatch(glob))) == want, (glob, name)
    assert one(spark, F.lit("a/b").rlike(pattern.wildmatch("*", path=False)))
    assert one(spark, F.lit("AB").rlike(pattern.wildmatch("a[b]", ignore_case=True)))


def test_pathspec_and_ignore(spark):
    paths = ["a.c", "d/a.c", "d/e/b.h", "D/x.c", "d/[x]", "z"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = lambda specs, prefix="": [r.path for r in rows.where(pattern.pathspec(specs, F.col("path"), prefix)).collect()]
    assert got(["*.c"]) == ["a.c", "d/a.c", "D/x.c"]
    assert got([":(glob)*.c"]) == ["a.c"]
    assert got([":(glob)**/*.c", ":!D"]) == ["a.c", "d/a.c"]
    assert got(["d"]) == ["d/a.c", "d/e/b.h", "d/[x]"] and got(["d/"]) == got(["d"])
    assert got([":(icase)D"]) == ["d/a.c", "d/e/b.h", "D/x.c", "d/[x]"]
    assert got([":(literal)d/[x]"]) == ["d/[x]"] and got([":!d", ":^z"]) == ["a.c", "D/x.c"]
    assert got(["a.c"], "d/") == ["d/a.c"] and got([":/a.c"], "d/") == ["a.c"]
    with pytest.raises(ValueError):
        pattern.pathspec([":(nonsense)x"], F.col("path"))
    ignored = lambda rules: [r.path for r in rows.where(pattern.ignored(rules, F.col("path"))).collect()]
    assert ignored(["*.c", "!a.c"]) == ["D/x.c"]
    assert ignored(["d/", "!d/a.c"]) == ["d/a.c", "d/e/b.h", "d/[x]"]
    assert ignored(["/a.c", "e/"]) == ["a.c", "d/e/b.h"]


@pytest.mark.parametrize("seconds, minutes", [(0, 0), (1_700_000_000, 330), (951_782_399, -150), (-86_401, 60)])
def test_date_modes(spark, seconds, minutes):
    at = dt.datetime.fromtimestamp(seconds, dt.timezone(dt.timedelta(minutes=minutes)))
    show = lambda mode: one(spark, dates.render(F.lit(seconds).cast("long"), F.lit(minutes), mode))
    zone = at.strftime("%z")
    assert show("iso") == at.strftime("%Y-%m-%d %H:%M:%S ") + zone
    assert show("iso-strict") == at.strftime("%Y-%m-%dT%H:%M:%S") + ("Z" if minutes == 0 else f"{zone[:3]}:{zone[3:]}")
    assert show("rfc") == at.strftime(f"%a, {at.day} %b %Y %H:%M:%S ") + zone
    assert show("default") == at.strftime(f"%a %b {at.day} %H:%M:%S %Y ") + zone
    assert show("raw") == f"{seconds} {zone}" and show("unix") == str(seconds) and show("short") == at.strftime("%Y-%m-%d")
    for mode in ("iso", "iso-strict", "rfc", "raw"):
        assert dates.parse(show(mode)) == (seconds, minutes)


def test_loose_dates(spark):
    now = dates.parse("2024-03-31 15:00:00 +0000")[0]
    want = {"2 days ago": "2024-03-29 15:00:00", "yesterday": "2024-03-30 15:00:00", "last month": "2024-02-29 15:00:00", "noon": "2024-03-31 12:00:00", "last friday": "2024-03-29 15:00:00", "1 year 2 hours ago": "2023-03-31 13:00:00", "yesterday noon": "2024-03-30 12:00:00", "2020-01-02": "2020-01-02 00:00:00"}
    assert {k: dates.approximate(k, now) for k in want} == {k: dates.parse(v)[0] for k, v in want.items()}
    assert dates.expiry("never", now) == 0 and dates.expiry("all", now) == now
    with pytest.raises(ValueError):
        dates.approximate("no such day", now)
    ages = {10: "10 seconds ago", 100: "2 minutes ago", 3 * 3600: "3 hours ago", 5 * 86400: "5 days ago", 21 * 86400: "3 weeks ago", 100 * 86400: "3 months ago", 400 * 86400: "1 year, 1 month ago", 3000 * 86400: "8 years ago", -5: "in the future"}
    assert {a: one(spark, dates.render(F.lit(now - a).cast("long"), F.lit(0), "relative", F.lit(now))) for a in ages} == ages


MESSAGE = "\n\nFirst line\nof the subject..\n\nBody here.\n\nMore.\n\nReviewed-by: A\nSigned-off-by: B\n <b@x>\n"


def test_messages(spark):
    m = F.lit(MESSAGE)
    assert one(spark, messages.subject(m)) == "First line of the subject.."
    assert one(spark, messages.body(m)).startswith("Body here.\n\nMore.")
    assert one(spark, messages.slug(m)) == "First-line-of-the-subject"
    assert [(t.key, t.value) for t in one(spark, messages.trailers(m))] == [("Reviewed-by", "A"), ("Signed-off-by", "B <b@x>")]
    assert one(spark, messages.trailers(F.lit("only: subject"))) == []
    assert one(spark, messages.add_trailer(F.lit("s"), "K", F.lit("v"))) == "s\n\nK: v\n"
    assert one(spark, messages.add_trailer(F.lit("s\n\nK: v\n"), "k", F.lit("v"))) == "s\n\nK: v\n"
    assert one(spark, messages.stripspace(F.lit("\n\n a  \n\n\n\nb\t\n#c\n\n"), "#")) == " a\n\nb\n"
    assert one(spark, messages.stripspace(F.lit(" \n \n"))) == ""
    i = one(spark, messages.identity(F.lit("A B <a@b> 12 -0130")))
    assert (i.name, i.email, i.seconds, i.offset) == ("A B", "a@b", 12, -90)
    assert one(spark, messages.identity(F.lit("no address"))) is None
    assert one(spark, messages.quoted_path(F.lit('a"\n\\é'))) == '"a\\"\\n\\\\\\303\\251"'
    assert one(spark, messages.mail_word(F.lit("é a"))) == "=?UTF-8?q?=C3=A9_a?=" and one(spark, messages.mail_word(F.lit("plain"))) == "plain"
    assert one(spark, messages.redacted_url(F.lit("https://u:p@h/x@y"))) == "https://h/x@y"
    names = ["v1.10", "v1.9", "v1.9.1", "v2", "v1.09"]
    keys = {n: one(spark, messages.version_key(F.lit(n))) for n in names}
    assert sorted(["v1.10", "v1.9", "v1.9.1", "v2"], key=keys.get) == ["v1.9", "v1.9.1", "v1.10", "v2"] and keys["v1.09"] == keys["v1.9"]
    for text, want in {"yes": True, "off": False, "": False, "0": False, "2k": True, "maybe": None}.items():
        assert one(spark, messages.bool_value(F.lit(text))) is want
    assert one(spark, messages.quoted(F.lit("it's!"), "shell")) == "'it'\\''s'\\!''"
    assert one(spark, messages.quoted(F.lit("a'\\\n"), "python")) == "'a\\'\\\\\\n'"


def test_formats(spark):
    fields = {"oid": F.lit("0123456789abcdef"), "author_name": F.lit("Ann"), "author_email": F.lit("ann@x"), "message": F.lit(MESSAGE), "parents": F.lit("aaaaaaaaaa bbbbbbbbbb"), "decorations": F.lit("")}
    show = lambda text: one(spark, format.compile_log(text, fields))
    assert show("%h|%p|%>(6)%an|%><(7)%an|%al%x21%%%q") == "0123456|aaaaaaa bbbbbbb|   Ann|  Ann  |ann!%%q"
    assert show("%an%+d%+s") == "Ann\nFirst line of the subject.." and show("x%n%-dy") == "xy" and show("%<(5,mtrunc)%s") == "Fi...t"[:2] + ".." + "."
    assert show("%(trailers:key=reviewed-by)") == "A"
    with pytest.raises(ValueError):
        format.compile_log("%cn", fields)
    ref = {"refname": F.lit("refs/heads/a/b"), "objectname": F.lit("0123456789"), "upstream": F.lit(" ")}
    show = lambda text, quote=None: one(spark, format.compile_ref(text, ref, quote))
    assert show("%(refname:short) %(refname:lstrip=1) %(refname:lstrip=-1) %(refname:rstrip=1)") == "a/b heads/a/b b refs/heads/a"
    assert show("%(if)%(upstream)%(then)yes%(else)no%(end)%41%%") == "noA%" and show("%(if:notequals=x)%(refname:short)%(then)%(align:6,right)%(refname:short)%(end)%(end)") == "   a/b"
    assert show("%(refname:short)", "shell") == "'a/b'"
    for bad in ("%(if)x", "%(then)", "%(refname:nonsense)"):
        with pytest.raises(ValueError):
            format.compile_ref(bad, ref)
    assert re.match("x", "x")
