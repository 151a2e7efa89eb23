"""Scalar functions with the semantics of an embedded SQL engine, as column expressions.

Where Spark's function of the same name differs, the difference is stated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; null for a zero divisor, where ANSI mode raises."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return F.when(b != 0, a % F.when(b != 0, b))


def add_or_real(a: Column, b: Column) -> Column:
    """Sum of integers as text of an integer, or of a real where 64 bits overflow."""
    return F.coalesce(F.try_add(a, b).cast("string"), (a.cast("double") + b.cast("double")).cast("string"))


def like(text: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE that ignores the case of ASCII letters only."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape is not None and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(_either_case(pattern[i]))
        else:
            out.append("[\\s\\S]*" if c == "%" else "[\\s\\S]" if c == "_" else _either_case(c))
        i += 1
    return text.rlike("\\A" + "".join(out) + "\\z")


def _either_case(c: str) -> str:
    return f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) if c.isascii() else c


def glob_pattern(pattern: str) -> str:
    """A regular expression for a GLOB pattern: * ? [set] [^set], with case."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and (end := pattern.find("]", i + 3 if pattern[i + 1 : i + 2] == "^" else i + 2)) > 0:
            body = pattern[i + 1 : end]
            no = body.startswith("^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if no else body)
            out.append(f"[{'^' if no else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c) if c.isascii() else c)
        i += 1
    return "\\A" + "".join(out) + "\\z"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_pattern(pattern))


def cast_integer(text: Column) -> Column:
    """CAST(text AS INTEGER): the longest integer prefix after white space, 0 if there is none."""
    return F.coalesce(F.expr("1").cast("long") * F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1).try_cast("long"), F.lit(0))), F.lit(None).cast("long"))


def substr(text: Column, start: int, length: int | None = None) -> Column:
    """substr: characters count from 1, from the end if negative; start 0 is the place before the first; a negative length goes left."""
    n = F.char_length(text)
    first = F.lit(start) if start > 0 else F.lit(0) if start == 0 else n + start + 1
    if length is None:
        lo, hi = first, n + 1
    elif length >= 0:
        lo, hi = first, first + length
    else:
        lo, hi = first + length, first
    if start < 0 and length is not None and length >= 0:
        hi = first + length
    lo = F.greatest(lo, F.lit(1))
    return F.when(text.isNotNull(), F.substring(text, lo, F.greatest(hi - lo, F.lit(0))))


def scalar_max(*columns: Column) -> Column:
    """max(a, b, ...): null if any is null, where greatest() skips nulls."""
    return F.when(_none_null(columns), F.greatest(*columns))


def scalar_min(*columns: Column) -> Column:
    return F.when(_none_null(columns), F.least(*columns))


def _none_null(columns: tuple[Column, ...]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull()
    return ok


def total(value: Column) -> Column:
    """An aggregate: sum as a real, 0.0 over no rows."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def group_concat(value: Column, separator: str = ",", *order: Column, distinct: bool = False) -> Column:
    """An aggregate: values in the given order (else in their own), joined; null over no values."""
    if distinct:
        items = F.array_sort(F.collect_set(value.cast("string")))
    else:
        keys = order or (value,)
        rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), value.cast("string").alias("v")))))
        items = F.transform(rows, lambda r: r["v"])
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def quote(value: Column) -> Column:
    """A text value as an SQL literal; NULL for null."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def unicode_of(text: Column) -> Column:
    """Code point of the first character; null for an empty text."""
    return F.when(F.char_length(text) > 0, F.ascii(text).cast("long"))


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def seeded_random(seed: Column, index: Column) -> Column:
    """A 64-bit number fixed by its seed and index."""
    return F.xxhash64(seed, index)


def seeded_blob(seed: Column, n: int) -> Column:
    """n bytes fixed by their seed."""
    blocks = F.concat(*(F.sha2(F.concat(seed.cast("string"), F.lit(f":{i}")).cast("binary"), 256) for i in range(-(-n // 32))))
    return F.unhex(F.substring(blocks, 1, 2 * n))


def affirm(condition: Column, code: str) -> Column:
    """1 if the condition holds; else the query fails with assert:<code>.  For eager checks; replay has a column for it."""
    if not 1 <= len(code.encode()) <= 128:
        raise ValueError("a code has 1 to 128 bytes")
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(1)).otherwise(F.raise_error(F.lit(f"assert:{code}")).cast("int"))


def soundex(text: Column) -> Column:
    """soundex, with ?000 for a text without letters."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")
    return F.when(letters == "", "?000").otherwise(F.soundex(letters))
