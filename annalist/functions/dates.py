"""Dates of a log: rendering of (seconds, offset) in the usual modes, and parsers that run while a plan is built."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _pick(names, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), i.cast("int"))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def civil(days: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of days since 1970."""
    date = F.date_from_unix_date(days.cast("int"))
    return F.year(date), F.month(date), F.dayofmonth(date)


def zone(minutes: Column, colon: bool = False) -> Column:
    """``+hhmm`` of an offset in minutes."""
    size = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), _two(F.floor(size / 60)), F.lit(":" if colon else ""), _two(size % 60))


def render(seconds: Column, minutes: Column, mode: str = "default", now: Column | None = None) -> Column:
    """The text of a time in its own zone; modes: default, iso, iso-strict, rfc, short, raw, unix, relative (needs ``now``)."""
    if mode == "unix":
        return seconds.cast("string")
    if mode == "raw":
        return F.concat(seconds.cast("string"), F.lit(" "), zone(minutes))
    if mode == "relative":
        return relative(seconds, now)
    local = seconds + minutes * 60
    days, rest = F.floor(local / 86400), F.pmod(local, F.lit(86400))
    year, month, day = civil(days)
    clock = F.concat(_two(F.floor(rest / 3600)), F.lit(":"), _two(F.floor(rest / 60) % 60), F.lit(":"), _two(rest % 60))
    date = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), _two(month), F.lit("-"), _two(day))
    weekday = _pick(_DAYS, F.pmod(days + 3, F.lit(7)) + 1)
    if mode == "short":
        return date
    if mode == "iso":
        return F.concat(date, F.lit(" "), clock, F.lit(" "), zone(minutes))
    if mode == "iso-strict":
        return F.concat(date, F.lit("T"), clock, F.when(minutes == 0, "Z").otherwise(zone(minutes, True)))
    if mode == "rfc":
        return F.concat(weekday, F.lit(", "), day.cast("string"), F.lit(" "), _pick(_MONTHS, month), F.lit(" "), year.cast("string"), F.lit(" "), clock, F.lit(" "), zone(minutes))
    if mode == "default":
        return F.concat(weekday, F.lit(" "), _pick(_MONTHS, month), F.lit(" "), day.cast("string"), F.lit(" "), clock, F.lit(" "), year.cast("string"), F.lit(" "), zone(minutes))
    raise ValueError(f"unknown date mode {mode!r}")


def relative(seconds: Column, now: Column) -> Column:
    """``n units ago``, rounded to the unit that the age calls for."""
    age = now - seconds

    def ago(n: Column, unit: str) -> Column:
        n = n.cast("long")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    minutes = F.floor((age + 30) / 60)
    hours = F.floor((minutes + 30) / 60)
    days = F.floor((hours + 12) / 24)
    months = F.floor((days * 12 * 2 + 365) / (365 * 2))
    years, odd = F.floor(months / 12).cast("long"), (months % 12).cast("long")
    both = F.concat(years.cast("string"), F.when(years == 1, " year").otherwise(" years"), F.when(odd > 0, F.concat(F.lit(", "), ago(odd, "month"))).otherwise(F.lit(" ago")))
    return (
        F.when(age < 0, "in the future").when(age < 90, ago(age, "second")).when(minutes < 90, ago(minutes, "minute")).when(hours < 36, ago(hours, "hour"))
        .when(days < 14, ago(days, "day")).when(days < 70, ago(F.floor((days + 3) / 7), "week")).when(days < 365, ago(F.floor((days + 15) / 30), "month"))
        .when(days < 1825, both).otherwise(ago(F.floor((days + 183) / 365), "year"))
    )


def parse(text: str) -> tuple[int, int]:
    """(seconds, offset in minutes) of a date in raw, ISO or mail form; other texts raise ValueError.  No zone: UTC."""
    text = text.strip()
    if m := re.fullmatch(r"@?(-?\d+)(?: ([+-])(\d\d)(\d\d))?", text):
        return int(m[1]), (1 if m[2] != "-" else -1) * (60 * int(m[3]) + int(m[4])) if m[2] else 0
    m = re.fullmatch(r"(\d{4})[-./](\d\d?)[-./](\d\d?)(?:[T ](\d\d?):(\d\d)(?::(\d\d))?(?:\.\d+)?)?\s*(Z|[+-]\d\d:?\d\d)?", text)
    if m:
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
    elif m := re.fullmatch(r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?(\d\d?) ([A-Z][a-z]{2}) (\d{4}) (\d\d):(\d\d)(?::(\d\d))?\s*(Z|GMT|UTC|[+-]\d{4})?", text):
        if m[2] not in _MONTHS:
            raise ValueError(f"no month {m[2]!r}")
        y, mo, d = int(m[3]), _MONTHS.index(m[2]) + 1, int(m[1])
    else:
        raise ValueError(f"not a date: {text!r}")
    z = (m[7] or "").replace(":", "")
    offset = (1 if z[0] == "+" else -1) * (60 * int(z[1:3]) + int(z[3:5])) if z[:1] in ("+", "-") else 0
    at = dt.datetime(y, mo, d, int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), tzinfo=dt.timezone.utc)
    return int(at.timestamp()) - 60 * offset, offset


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 0, "year": 0}
_NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten".split())} | {"a": 1, "an": 1, "last": 1}


def approximate(text: str, now: int) -> int:
    """Seconds of a loose date such as ``2 days ago``, ``yesterday``, ``last monday``, ``noon`` or a date that ``parse`` reads; UTC."""
    try:
        return parse(text)[0]
    except ValueError:
        pass
    at = dt.datetime.fromtimestamp(now, dt.timezone.utc)
    words = [w for w in re.split(r"[^a-z0-9:]+", text.lower()) if w and w not in ("ago", "and", "at")]
    number = None
    for w in words:
        unit = w.rstrip("s") if w not in ("s",) else w
        if w.isdigit():
            number = int(w)
        elif w in _NUMBERS:
            number = _NUMBERS[w]
        elif unit in _UNITS:
            k = 1 if number is None else number
            if unit in ("month", "year"):
                months = at.year * 12 + at.month - 1 - k * (12 if unit == "year" else 1)
                year, month = divmod(months, 12)
                last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(1)).day
                at = at.replace(year=year, month=month + 1, day=min(at.day, last))
            else:
                at -= dt.timedelta(seconds=k * _UNITS[unit])
            number = None
        elif w == "yesterday":
            at -= dt.timedelta(1)
        elif w in ("now", "today"):
            pass
        elif w in ("noon", "midnight", "tea"):
            hour = {"noon": 12, "midnight": 0, "tea": 17}[w]
            if at.hour < hour and "yesterday" not in words and len(words) == 1:
                at -= dt.timedelta(1)
            at = at.replace(hour=hour, minute=0, second=0)
        elif w[:3].title() in _DAYS and w in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", *(x.lower() for x in _DAYS)):
            back = (at.weekday() - _DAYS.index(w[:3].title())) % 7 or 7
            at -= dt.timedelta(back + 7 * ((number or 1) - 1))
            number = None
        elif m := re.fullmatch(r"(\d\d?):(\d\d)(?::(\d\d))?", w):
            at = at.replace(hour=int(m[1]), minute=int(m[2]), second=int(m[3] or 0))
        else:
            raise ValueError(f"not a date: {text!r}")
    return int(at.timestamp())


def expiry(text: str, now: int) -> int:
    """``never`` or ``false``: 0 (nothing expires); ``all`` or ``now``: everything up to now; else ``approximate``."""
    word = text.strip().lower()
    if word in ("never", "false"):
        return 0
    if word in ("all", "now"):
        return now
    return approximate(text, now)
