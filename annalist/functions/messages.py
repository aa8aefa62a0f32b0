"""Columns over commit messages, identities, names and option values; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def stripspace(text: Column, comment: str | None = None) -> Column:
    """Lines without trailing white space, no empty lines at the ends, one between paragraphs, a line feed at the end."""
    lines = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"[ \t\r\x0b\x0c]+$", ""))
    if comment:
        lines = F.filter(lines, lambda x: ~x.startswith(comment))
    body = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    body = F.regexp_replace(F.regexp_replace(body, "^\n+", ""), "\n+$", "")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def subject(message: Column) -> Column:
    """The lines of the first paragraph, joined by a space."""
    rest = F.regexp_replace(message, r"^(?:[ \t\r]*\n)+", "")
    first = F.regexp_extract(rest, r"\A((?:[^\n]*\S[^\n]*(?:\n|\z))*)", 1)
    return F.trim(F.regexp_replace(first, r"[ \t\r]*\n[ \t\r]*", " "))


def body(message: Column) -> Column:
    """What follows the first paragraph and the empty lines after it."""
    rest = F.regexp_replace(message, r"^(?:[ \t\r]*\n)+", "")
    return F.regexp_replace(F.regexp_replace(rest, r"\A(?:[^\n]*\S[^\n]*(?:\n|\z))*", ""), r"\A(?:[ \t\r]*\n)+", "")


def slug(message: Column, most: int | None = 52) -> Column:
    """The subject as a file name: runs of other characters become ``-``, dots do not repeat, no dot or dash at the ends."""
    out = F.regexp_replace(subject(message), r"[^A-Za-z0-9._]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), r"^-+", "")
    if most:
        out = F.substring(out, 1, most)
    return F.regexp_replace(out, r"[-.]+$", "")


def identity(raw: Column) -> Column:
    """struct(name, email, seconds, offset) of ``Name <email> 1700000000 +0200``; parts that are missing are null."""
    part = lambda i: F.regexp_extract(raw, r"\A([^<]*)<([^>]*)>(?: (-?\d+) ([+-]\d{4}))?\s*\z", i)
    offset = F.try_divide(F.nullif(part(4), F.lit("")).cast("int"), F.lit(1)).cast("int")
    minutes = F.when(offset < 0, -(F.floor(-offset / 100) * 60 + (-offset) % 100)).otherwise(F.floor(offset / 100) * 60 + offset % 100).cast("int")
    known = raw.rlike(r"\A[^<]*<[^>]*>(?: -?\d+ [+-]\d{4})?\s*\z")
    return F.when(known, F.struct(F.trim(part(1)).alias("name"), part(2).alias("email"), F.nullif(part(3), F.lit("")).cast("long").alias("seconds"), minutes.alias("offset")))


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


_TRAILER = r"\A[A-Za-z0-9-]+[ \t]*:"


def _block(message: Column) -> Column:
    """Lines of the last paragraph, if it holds trailers: every line one (or a continuation), or a quarter of them beside a known one."""
    whole = F.regexp_replace(message, r"\s+\z", "")
    parts = F.split(whole, r"\n[ \t]*\n")
    lines = _lines(F.element_at(parts, -1))
    marks = F.transform(lines, lambda x: F.when(x.rlike(_TRAILER), 1).when(x.rlike(r"\A[ \t]"), 0).otherwise(-1))
    good, bad = F.size(F.filter(marks, lambda m: m == 1)), F.size(F.filter(marks, lambda m: m == -1))
    known = F.exists(lines, lambda x: x.startswith("Signed-off-by: ") | x.startswith("(cherry picked from commit "))
    return F.when((F.size(parts) > 1) & (good > 0) & ((bad == 0) | (known & (good * 3 >= bad))), lines).otherwise(F.array().cast("array<string>"))


def trailers(message: Column) -> Column:
    """array of struct(key, value) of the message's last paragraph; continued lines are joined by a space."""
    text = F.regexp_replace(F.array_join(_block(message), "\n"), r"\n[ \t]+", " ")
    lines = F.filter(_lines(text), lambda x: x.rlike(_TRAILER))
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"\A([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"\A[^:]*:(.*)", 1)).alias("value")))


def trailer_values(message: Column, key: str, separator: str = ", ") -> Column:
    return F.array_join(F.transform(F.filter(trailers(message), lambda t: F.lower(t["key"]) == key.lower()), lambda t: t["value"]), separator)


def add_trailer(message: Column, key: str, value: Column, if_exists: str = "addIfDifferent") -> Column:
    """The message with a trailer at the end; ``if_exists``: addIfDifferent, doNothing or add."""
    base = F.regexp_replace(message, r"\s+\z", "")
    line = F.concat(F.lit(f"{key}: "), value)
    glue = F.when(F.size(_block(message)) > 0, "\n").otherwise("\n\n")
    new = F.concat(base, glue, line, F.lit("\n"))
    mine = F.filter(trailers(message), lambda t: F.lower(t["key"]) == key.lower())
    there = {"add": F.lit(False), "doNothing": F.size(mine) > 0, "addIfDifferent": F.exists(mine, lambda t: t["value"] == value)}[if_exists]
    return F.when(there, F.concat(base, F.lit("\n"))).otherwise(new)


def quoted_path(path: Column) -> Column:
    """C-style quotes where a path holds control characters, quotes, backslashes or bytes beyond ASCII (as octal)."""
    raw = F.transform(F.sequence(F.lit(1), F.octet_length(path)), lambda i: F.hex(F.substring(path.cast("binary"), i, F.lit(1))))
    names = {"07": "\\a", "08": "\\b", "09": "\\t", "0A": "\\n", "0B": "\\v", "0C": "\\f", "0D": "\\r", "22": '\\"', "5C": "\\\\"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])

    def one(h: Column) -> Column:
        code = F.conv(h, 16, 10).cast("int")
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0"))
        return F.when(table[h].isNotNull(), table[h]).when((code < 32) | (code > 126), octal).otherwise(F.char(code))

    return F.when(path.rlike(r'[\x00-\x1f"\\]|[^\x00-\x7e]'), F.concat(F.lit('"'), F.array_join(F.transform(raw, one), ""), F.lit('"'))).otherwise(path)


def quoted(value: Column, style: str) -> Column:
    """The value as a literal of a shell, Perl, Python or Tcl program."""
    if style == "shell":
        return F.concat(F.lit("'"), F.regexp_replace(value, r"(['!])", r"'\\$1'"), F.lit("'"))
    if style in ("perl", "python"):
        out = F.regexp_replace(value, r"([\\'])", r"\\$1")
        return F.concat(F.lit("'"), F.replace(out, F.lit("\n"), F.lit("\\n")) if style == "python" else out, F.lit("'"))
    if style == "tcl":
        out = F.regexp_replace(value, r'([\[\]{}$\\"])', r"\\$1")
        for raw, name in (("\f", "f"), ("\r", "r"), ("\n", "n"), ("\t", "t"), ("\v", "v")):
            out = F.replace(out, F.lit(raw), F.lit("\\" + name))
        return F.concat(F.lit('"'), out, F.lit('"'))
    raise ValueError(f"unknown style {style!r}")


def rewritten_url(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The URL with the longest matching ``(instead_of, base)`` replaced; the first of equally long ones."""
    out = url
    for old, base in sorted(reversed(list(rules)), key=lambda r: len(r[0])):
        out = F.when(url.startswith(old), F.concat(F.lit(base), F.substring(url, len(old) + 1, 1 << 30))).otherwise(out)
    return out


def redacted_url(url: Column) -> Column:
    """The URL without user and password."""
    return F.regexp_replace(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")


def version_key(name: Column) -> Column:
    """A key that sorts names by version: runs of digits compare as numbers (up to 40 digits), other characters as they are."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    pad = lambda p: F.regexp_replace(p, r"\A0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\A\d"), F.concat(F.lpad(F.length(pad(p)).cast("string"), 3, "0"), pad(p))).otherwise(p)), "\x01")


def size_value(text: Column) -> Column:
    """Bytes of ``10``, ``10k``, ``10m`` or ``10g``; null for other texts."""
    unit = F.lower(F.regexp_extract(text, r"\A\s*-?\d+([kKmMgG]?)\s*\z", 1))
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1).cast("long")
    return F.when(text.rlike(r"\A\s*-?\d{1,9}[kKmMgG]?\s*\z"), F.nullif(F.regexp_extract(text, r"\A\s*(-?\d+)", 1), F.lit("")).cast("long") * factor)


def bool_value(text: Column) -> Column:
    """yes, on, true and numbers other than 0 (and a key without value: null text) are true; no, off, false, 0 and the empty text false."""
    word = F.lower(F.trim(text))
    number = F.when(text.rlike(r"\A\s*-?\d{1,9}[kKmMgG]?\s*\z"), size_value(text) != 0)
    return F.when(text.isNull() | word.isin("true", "yes", "on"), True).when(word.isin("false", "no", "off", ""), False).otherwise(number)


def mail_word(text: Column, charset: str = "UTF-8") -> Column:
    """The text as an encoded word of a mail header, if it holds anything beyond printable ASCII."""
    raw = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.hex(F.substring(text.cast("binary"), i, F.lit(1))))

    def one(h: Column) -> Column:
        code = F.conv(h, 16, 10).cast("int")
        char = F.char(code)
        return F.when(h == "20", "_").when((code > 32) & (code < 127) & ~char.isin(*'=?_"(),.:;<>@[\\]'), char).otherwise(F.concat(F.lit("="), h))

    return F.when(text.rlike(r"[^\x20-\x7e]|=\?"), F.concat(F.lit(f"=?{charset}?q?"), F.array_join(F.transform(raw, one), ""), F.lit("?="))).otherwise(text)


def kind_of_mode(mode: Column) -> Column:
    return F.when(mode == 0o40000, "tree").when(mode == 0o120000, "symlink").when(mode == 0o160000, "gitlink").when(mode == 0o100755, "executable").when(F.shiftright(mode, 12) == 0o10, "file")


def type_changed(old: Column, new: Column) -> Column:
    """Do two modes differ in kind (a file against a link or a tree), the executable bit apart?"""
    return F.shiftright(old, 12) != F.shiftright(new, 12)


def stage_of_flags(flags: Column) -> Column:
    return F.shiftright(flags, 12).bitwiseAND(3)


def without_trailing_blanks(text) -> Column:
    """``text`` without blanks and tabs at the ends of its lines."""
    return F.regexp_replace(text, r"(?<![ \t])[ \t]++(?=\n|\z)", "")
