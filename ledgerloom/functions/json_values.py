"""JSON reading, building and changing.

Reads use Spark's path functions and variants; changes of a document have no built-in and run in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of an event's payload: bytes, nodes, depth.
MOST_BYTES, MOST_NODES, MOST_DEPTH = 16_384, 4_096, 32


def extract(document: Column, path: str) -> Column:
    """The value at a path as text; null if the document is no JSON."""
    return F.get_json_object(document, path)


def valid(document: Column) -> Column:
    return F.when(document.isNotNull(), F.try_parse_json(document).isNotNull())


def type_of(document: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; null where there is nothing."""
    at = F.try_variant_get(F.try_parse_json(document), path, "variant")
    kind = F.schema_of_variant(at)
    truth = F.when(at.try_cast("boolean"), "true").otherwise("false") if hasattr(at, "try_cast") else F.lit("true")
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", truth).when(kind == "BIGINT", "integer").when(kind == "STRING", "text")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "real")
    )


def array_length(document: Column) -> Column:
    return F.json_array_length(document)


def group_array(value: Column, *order: Column) -> Column:
    """An aggregate: the values in the given order as a JSON array."""
    keys = order or (value,)
    rows = F.sort_array(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), value.alias("v"))))
    return F.to_json(F.transform(rows, lambda r: r["v"]))


def group_object(key: Column, value: Column) -> Column:
    """An aggregate: a JSON object of keys and values, by key."""
    rows = F.sort_array(F.collect_list(F.struct(key.alias("key"), value.alias("value"))))
    return F.to_json(F.map_from_entries(rows))


def canonical(value: object) -> str:
    """JSON text with sorted keys and no white space; numbers must be finite, and the bounds hold."""
    nodes = 0

    def check(v: object, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if depth > MOST_DEPTH or nodes > MOST_NODES:
            raise ValueError("too_large: payload")
        if isinstance(v, dict):
            for k, x in v.items():
                if not isinstance(k, str):
                    raise ValueError("mismatch: keys are text")
                check(x, depth + 1)
        elif isinstance(v, list | tuple):
            for x in v:
                check(x, depth + 1)

    check(value, 1)
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("too_large: payload")
    return text


def _steps(path: str) -> list[str | int]:
    if not path.startswith("$"):
        raise ValueError("a path begins with $")
    out: list[str | int] = []
    for part in path[1:].replace("[", ".[").split("."):
        if part.startswith("["):
            out.append(int(part[1:-1]))
        elif part:
            out.append(part)
    return out


def _change(document: object, steps: list[str | int], value: object, create: bool, overwrite: bool) -> object:
    if not steps:
        return value if overwrite else document
    at = document
    for s in steps[:-1]:
        if isinstance(at, dict) and isinstance(s, str) and s in at or isinstance(at, list) and isinstance(s, int) and s < len(at):
            at = at[s]
        else:
            return document
    last = steps[-1]
    if isinstance(at, dict) and isinstance(last, str):
        if (last in at and overwrite) or (last not in at and create):
            at[last] = value
    elif isinstance(at, list) and isinstance(last, int):
        if last < len(at) and overwrite:
            at[last] = value
        elif last == len(at) and create:
            at.append(value)
    return document


def _drop(document: object, steps: list[str | int]) -> object:
    at = document
    for s in steps[:-1]:
        try:
            at = at[s]
        except (KeyError, IndexError, TypeError):
            return document
    if isinstance(at, dict):
        at.pop(steps[-1], None)
    elif isinstance(at, list) and isinstance(steps[-1], int) and steps[-1] < len(at):
        del at[steps[-1]]
    return document


def merge_patch(document: object, patch: object) -> object:
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(document) if isinstance(document, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def _changer(work):
    @F.pandas_udf(T.StringType())
    def change(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for documents, values in batches:
            out = []
            for d, v in zip(documents, values, strict=True):
                try:
                    out.append(None if d is None else json.dumps(work(json.loads(d), v), separators=(",", ":"), ensure_ascii=False))
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return change


def set_value(document: Column, path: str, value: Column) -> Column:
    """json_set with a value given as JSON text: makes or overwrites."""
    return _changer(lambda d, v: _change(d, _steps(path), json.loads(v), True, True))(document, value)


def insert_value(document: Column, path: str, value: Column) -> Column:
    return _changer(lambda d, v: _change(d, _steps(path), json.loads(v), True, False))(document, value)


def replace_value(document: Column, path: str, value: Column) -> Column:
    return _changer(lambda d, v: _change(d, _steps(path), json.loads(v), False, True))(document, value)


def remove_value(document: Column, path: str) -> Column:
    return _changer(lambda d, v: _drop(d, _steps(path)))(document, F.lit(""))


def patch(document: Column, change: Column) -> Column:
    return _changer(lambda d, v: merge_patch(d, json.loads(v)))(document, change)


TREE = T.ArrayType(T.StructType([T.StructField("fullkey", T.StringType()), T.StructField("type", T.StringType()), T.StructField("atom", T.StringType())]))


@F.pandas_udf(TREE)
def tree(documents: pd.Series) -> pd.Series:
    """json_tree: every node of a document with its path, type and, if it is no container, its value; explode it."""

    def walk(v, path):
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else "integer" if isinstance(v, int) else "real" if isinstance(v, float) else "text"
        yield {"fullkey": path, "type": kind, "atom": None if kind in ("object", "array", "null") else v if isinstance(v, str) else json.dumps(v)}
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{path}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{path}[{i}]")

    def nodes(d):
        try:
            return list(walk(json.loads(d), "$")) if d is not None else []
        except ValueError:
            return []

    return documents.map(nodes)


def each(document: Column) -> Column:
    """json_each of an object of texts and numbers: an array of (key, value), both as text; explode it."""
    return F.map_entries(F.from_json(document, "map<string,string>"))
