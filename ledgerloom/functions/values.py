"""The exact value model: storage classes, row keys, storage equality, digests."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tags of the row-key encoding.
TAG_NULL, TAG_INTEGER, TAG_REAL, TAG_TEXT, TAG_BLOB = 0, 1, 2, 3, 4
ROW_KEY_PREFIX = "rk1:"
MOST_KEY_PARTS = 64


def bind_value(value: object) -> object:
    """A host value as a storable one: booleans are 0 and 1, other numbers must be finite and integers of 64 bits."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError("binding: integer out of range")
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("binding: real must be finite")
        return value
    if value is None or isinstance(value, str | bytes):
        return value
    raise TypeError(f"binding: {type(value).__name__} can't be stored")


def storage_class(value: object) -> str:
    return {type(None): "null", int: "integer", bool: "integer", float: "real", str: "text", bytes: "blob"}[type(value)]


def storage_equal(a: object, b: object) -> bool:
    """Same class and same bits: 1 and 1.0 differ, null equals null."""
    if storage_class(a) != storage_class(b):
        return False
    return struct.pack(">d", a) == struct.pack(">d", b) if isinstance(a, float) else a == b


def row_key(values: Sequence[object]) -> str:
    """The key of a tuple of 1 to 64 values as text."""
    if not 1 <= len(values) <= MOST_KEY_PARTS:
        raise ValueError("a row key has 1 to 64 parts")
    out = struct.pack(">H", len(values))
    for v in values:
        v = bind_value(v)
        if v is None:
            out += bytes([TAG_NULL])
        elif isinstance(v, int):
            out += struct.pack(">Bq", TAG_INTEGER, v)
        elif isinstance(v, float):
            out += struct.pack(">Bd", TAG_REAL, v)
        else:
            raw = v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v
            out += struct.pack(">BI", TAG_TEXT if isinstance(v, str) else TAG_BLOB, len(raw)) + raw
    return ROW_KEY_PREFIX + out.hex()


@F.pandas_udf(T.StringType())
def _real_bits(x: pd.Series) -> pd.Series:
    """Big-endian bits of doubles; Spark has no built-in for them."""
    return x.map(lambda v: None if pd.isna(v) else struct.pack(">d", v).hex())


def row_key_column(parts: Sequence[tuple[Column, str]]) -> Column:
    """``row_key`` of columns, each with its kind: integer, real, text or blob.  JVM-side but for reals."""
    if not 1 <= len(parts) <= MOST_KEY_PARTS:
        raise ValueError("a row key has 1 to 64 parts")
    low = lambda c: F.lower(F.hex(c))
    pieces = [F.lit(ROW_KEY_PREFIX + struct.pack(">H", len(parts)).hex())]
    for c, kind in parts:
        if kind == "integer":
            body = F.concat(F.lit("01"), F.lpad(low(c.cast("long")), 16, "0"))
        elif kind == "real":
            body = F.concat(F.lit("02"), _real_bits(c.cast("double")))
        else:
            raw = c.cast("binary")
            body = F.concat(F.lit("03" if kind == "text" else "04"), F.lpad(low(F.octet_length(raw).cast("long")), 8, "0"), low(raw))
        pieces.append(F.coalesce(body, F.lit("00")))
    return F.concat(*pieces)


def value_equal(a: Column, b: Column) -> Column:
    """Exact equality of columns of one type; null equals null."""
    return a.eqNullSafe(b)


def object_id(domain: str, tx_id: str, step: int) -> str:
    """An id made from a transaction and a step; the parts are length-prefixed, so no two tuples run together."""
    parts = [domain.encode(), tx_id.encode(), struct.pack(">q", step)]
    return hashlib.sha256(b"".join(struct.pack(">I", len(p)) + p for p in parts)).hexdigest()


def content_hash(columns: Sequence[Column]) -> Column:
    """An aggregate that is equal for equal bags of rows, whatever their order and place: a sum of row hashes."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
