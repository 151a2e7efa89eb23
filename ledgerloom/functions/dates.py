"""Date functions over milliseconds since the epoch, in UTC, with the clock given as a column and never read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _local(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def datetime(ms: Column, *modifiers: str) -> Column:
    """YYYY-MM-DD HH:MM:SS in UTC after the modifiers."""
    return F.date_format(_modified(_local(ms), modifiers), "yyyy-MM-dd HH:mm:ss")


def date(ms: Column, *modifiers: str) -> Column:
    return F.date_format(_modified(_local(ms), modifiers), "yyyy-MM-dd")


def time(ms: Column, *modifiers: str) -> Column:
    return F.date_format(_modified(_local(ms), modifiers), "HH:mm:ss")


def unixepoch(ms: Column, *modifiers: str) -> Column:
    return F.unix_seconds(_modified(_local(ms), modifiers))


def julianday(ms: Column) -> Column:
    return ms / 86_400_000.0 + 2_440_587.5


# Format letters and the patterns that give the same text.
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS"}


def strftime(form: str, ms: Column, *modifiers: str) -> Column:
    """%Y %m %d %H %M %S %f %j %s %w %J %% and plain text."""
    at = _modified(_local(ms), modifiers)
    parts: list[Column] = []
    for piece in re.findall(r"%.|[^%]+", form):
        if piece in _FORMATS:
            parts.append(F.date_format(at, _FORMATS[piece]))
        elif piece == "%s":
            parts.append(F.unix_seconds(at).cast("string"))
        elif piece == "%w":
            parts.append((F.dayofweek(at) - 1).cast("string"))
        elif piece == "%J":
            parts.append(julianday(F.unix_millis(at)).cast("string"))
        else:
            parts.append(F.lit("%" if piece == "%%" else piece))
    return F.concat(*parts)


def _modified(at: Column, modifiers: tuple[str, ...]) -> Column:
    """'+N days' (months, years, hours, minutes, seconds), 'start of day/month/year', 'weekday N', 'utc', 'localtime'.

    A month past its end rolls over into the next, where Spark's own addition clamps.
    """
    for m in modifiers:
        if m in ("utc", "localtime"):
            continue
        if m.startswith("start of "):
            at = F.date_trunc(m.removeprefix("start of "), at)
        elif m.startswith("weekday "):
            ahead = (F.lit(int(m.removeprefix("weekday ")) + 7) - (F.dayofweek(at) - 1)) % 7
            at = at + F.make_dt_interval(days=ahead)
        elif found := re.fullmatch(r"([+-]?\d+) (day|month|year|hour|minute|second)s?", m):
            n, unit = int(found[1]), found[2]
            if unit in ("month", "year"):
                first = F.date_trunc("month", at)
                months = n * (12 if unit == "year" else 1)
                moved = F.add_months(first.cast("date"), months).cast("timestamp")
                at = moved + (at - first)
            else:
                at = at + F.make_dt_interval(**{f"{unit}s" if unit in ("day", "hour") else {"minute": "mins", "second": "secs"}[unit]: F.lit(n)})
        else:
            raise ValueError(f"no such modifier: {m}")
    return at


def current_timestamp_of(ms: Column) -> Column:
    """CURRENT_TIMESTAMP as pinned to a transaction."""
    return datetime(ms)


def timediff(a: Column, b: Column) -> Column:
    """Difference in whole days and the rest, as +DDDD HH:MM:SS."""
    seconds = F.abs(F.floor((a - b) / 1000))
    sign = F.when(a >= b, "+").otherwise("-")
    return F.concat(sign, F.lpad(F.floor(seconds / 86400).cast("string"), 4, "0"), F.lit(" "), F.date_format(F.timestamp_seconds(seconds % 86400), "HH:mm:ss"))
