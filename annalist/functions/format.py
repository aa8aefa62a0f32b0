"""Compilers of the two format languages: a format becomes one Column over named fields, so unused fields are pruned."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import messages

Fields = Mapping[str, Column]

#: Placeholders of the log format and the fields that they show.
PLACEHOLDERS = {
    "H": "oid", "T": "tree", "P": "parents", "an": "author_name", "ae": "author_email", "ad": "author_date", "at": "author_seconds", "cn": "committer_name",
    "ce": "committer_email", "cd": "committer_date", "ct": "committer_seconds", "B": "message", "D": "decorations", "N": "notes", "e": "encoding", "S": "source",
}


def _field(fields: Fields, name: str) -> Column:
    if name not in fields:
        raise ValueError(f"the format needs the field {name!r}")
    return F.coalesce(fields[name].cast("string"), F.lit(""))


def _derived(fields: Fields, abbrev: int) -> dict[str, Callable[[], Column]]:
    short = lambda name: F.substring(_field(fields, name), 1, abbrev)
    return {
        "h": lambda: short("oid"), "t": lambda: short("tree"), "p": lambda: F.array_join(F.transform(F.split(_field(fields, "parents"), " "), lambda x: F.substring(x, 1, abbrev)), " "),
        "al": lambda: messages.local_part(_field(fields, "author_email")), "cl": lambda: messages.local_part(_field(fields, "committer_email")),
        "s": lambda: messages.subject(_field(fields, "message")), "b": lambda: messages.body(_field(fields, "message")), "f": lambda: messages.slug(_field(fields, "message")),
        "d": lambda: F.when(_field(fields, "decorations") != "", F.concat(F.lit(" ("), _field(fields, "decorations"), F.lit(")"))).otherwise(""),
    }


def padded(value: Column, width: int, side: str, cut: str | None = None) -> Column:
    """The value in ``width`` characters: side ``<`` pads right, ``>`` left, ``><`` both; ``cut``: trunc, ltrunc or mtrunc."""
    if cut:
        keep = max(0, width - 2)
        left = (keep + 1) // 2
        forms = {"trunc": F.concat(F.substring(value, 1, keep), F.lit("..")), "ltrunc": F.concat(F.lit(".."), F.right(value, F.lit(keep))), "mtrunc": F.concat(F.substring(value, 1, left), F.lit(".."), F.right(value, F.lit(keep - left)))}
        value = F.when(F.char_length(value) > width, forms[cut]).otherwise(value)
    room = F.greatest(F.lit(width) - F.char_length(value), F.lit(0))
    if side == "<":
        return F.concat(value, F.repeat(F.lit(" "), room))
    if side == ">":
        return F.concat(F.repeat(F.lit(" "), room), value)
    half = F.floor(room / 2).cast("int")
    return F.concat(F.repeat(F.lit(" "), half), value, F.repeat(F.lit(" "), room - half))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.lit("")


_PAD = re.compile(r"%(<|>|><)\((\d+)(?:,(trunc|ltrunc|mtrunc))?\)")


def compile_log(text: str, fields: Fields, abbrev: int = 7) -> Column:
    """A log format: ``%H %an %s ...``, ``%n``, ``%%``, ``%x41``, ``%<(20,trunc)``, ``%(trailers:key=K)``, and ``%+x``, ``%-x``, ``% x``.

    Unknown placeholders stay as they are."""
    derived = _derived(fields, abbrev)
    out: list[Column] = []
    pending: tuple[int, str, str | None] | None = None
    i, plain = 0, ""

    def flush():
        nonlocal plain
        if plain:
            out.append(F.lit(plain))
            plain = ""

    while i < len(text):
        if text[i] != "%":
            plain += text[i]
            i += 1
            continue
        if m := _PAD.match(text, i):
            pending = (int(m[2]), m[1], m[3])
            i = m.end()
            continue
        magic = text[i + 1] if text[i + 1 : i + 2] in ("+", "-", " ") else ""
        rest = text[i + 1 + len(magic) :]
        value, used = None, 0
        if m := re.match(r"\(trailers:key=([A-Za-z0-9-]+)(?:,separator=([^)]*))?\)", rest):
            value, used = messages.trailer_values(_field(fields, "message"), m[1], m[2] if m[2] is not None else "\n"), m.end()
        elif m := re.match(r"x([0-9A-Fa-f]{2})", rest):
            value, used = F.lit(chr(int(m[1], 16))), 3
        elif rest[:1] == "n":
            value, used = F.lit("\n"), 1
        elif rest[:1] == "%":
            value, used = F.lit("%"), 1
        else:
            for size in (2, 1):
                name = rest[:size]
                if len(name) == size and (name in PLACEHOLDERS or name in derived):
                    value, used = _field(fields, PLACEHOLDERS[name]) if name in PLACEHOLDERS else derived[name](), size
                    break
        if value is None:
            plain += text[i]
            i += 1
            continue
        flush()
        if pending:
            value, pending = padded(value, *pending[:1], pending[1], pending[2]), None
        if magic == "+":
            value = F.when(value != "", F.concat(F.lit("\n"), value)).otherwise("")
        elif magic == " ":
            value = F.when(value != "", F.concat(F.lit(" "), value)).otherwise("")
        elif magic == "-":
            before = F.regexp_replace(_joined(out), "\n+$", "")
            out = [F.when(value == "", before).otherwise(_joined(out))]
        out.append(value)
        i += 1 + len(magic) + used
    flush()
    return _joined(out)


def _strip_parts(name: Column, n: int, left: bool) -> Column:
    parts = F.split(name, "/")
    keep = F.lit(-n) if n < 0 else F.greatest(F.size(parts) - n, F.lit(0))
    keep = F.least(keep, F.size(parts))
    return F.array_join(F.slice(parts, F.size(parts) - keep + 1, keep) if left else F.slice(parts, 1, keep), "/")


def short_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\Arefs/(?:heads|tags|remotes)/", "")


def _atom(spec: str, fields: Fields) -> Column:
    name, _, option = spec.partition(":")
    name = name.lstrip("*")
    if name in ("contents", "subject", "body"):
        text = _field(fields, "message")
        what = option or name
        if what == "sanitize":
            return messages.slug(text)
        return {"subject": messages.subject, "body": messages.body, "contents": lambda x: x}[what](text)
    value = _field(fields, name)
    if not option:
        return value
    key, _, arg = option.partition("=")
    if key == "short" and name in ("objectname", "tree", "parent"):
        return F.substring(value, 1, int(arg or 7))
    if key == "short":
        return short_name(value)
    if key in ("lstrip", "strip", "rstrip"):
        return _strip_parts(value, int(arg), key != "rstrip")
    if key == "localpart" or key == "trim":
        return messages.local_part(value) if key == "localpart" else F.regexp_replace(value, "^<|>$", "")
    raise ValueError(f"unknown option of %({spec})")


def compile_ref(text: str, fields: Fields, quote: str | None = None) -> Column:
    """A ref format: atoms ``%(refname:short)``, ``%(if)..%(then)..%(else)..%(end)``, ``%(if:equals=X)``,
    ``%(align:20,left)..%(end)``, ``%xx`` and ``%%``.  ``quote``: style of atoms outside of blocks."""
    tokens = re.findall(r"%\([^)]*\)|%%|%[0-9A-Fa-f]{2}|[^%]+|%", text)
    at = 0

    def block(stops: tuple[str, ...], outer: bool) -> tuple[Column, str]:
        nonlocal at
        out: list[Column] = []
        while at < len(tokens):
            t = tokens[at]
            at += 1
            if t in stops:
                return _joined(out), t
            if t.startswith("%(if"):
                test = t[4:-1]
                cond, _ = block(("%(then)",), False)
                yes, end = block(("%(else)", "%(end)"), False)
                no = block(("%(end)",), False)[0] if end == "%(else)" else F.lit("")
                if test.startswith(":equals="):
                    hit = cond == test[8:]
                elif test.startswith(":notequals="):
                    hit = cond != test[11:]
                else:
                    hit = F.trim(cond) != ""
                out.append(F.when(hit, yes).otherwise(no))
            elif t.startswith("%(align:"):
                args = [a.strip().split("=")[-1] for a in t[8:-1].split(",")]
                width = next(int(a) for a in args if a.isdigit())
                side = {"left": "<", "right": ">", "middle": "><"}[next((a for a in args if not a.isdigit()), "left")]
                out.append(padded(block(("%(end)",), False)[0], width, side))
            elif t in ("%(then)", "%(else)", "%(end)"):
                raise ValueError(f"{t} without its beginning")
            elif t.startswith("%("):
                value = _atom(t[2:-1], fields)
                out.append(messages.quoted(value, quote) if quote and outer else value)
            elif t == "%%":
                out.append(F.lit("%"))
            elif re.fullmatch(r"%[0-9A-Fa-f]{2}", t):
                out.append(F.lit(chr(int(t[1:], 16))))
            else:
                out.append(F.lit(t))
        if stops:
            raise ValueError(f"{' or '.join(stops)} is missing")
        return _joined(out), ""

    return block((), True)[0]
