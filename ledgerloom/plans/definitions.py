"""Input schemas of named queries and commands: a small closed subset of JSON Schema."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from ledgerloom.plans.policy import Code, Rejected

_KEYS = {
    "object": {"type", "properties", "required"},
    "array": {"type", "items", "maxItems"},
    "string": {"type", "maxLength", "enum"},
    "integer": {"type", "minimum", "maximum"},
    "number": {"type", "minimum", "maximum"},
    "boolean": {"type"},
    "null": {"type"},
}


@dataclass(frozen=True)
class Schema:
    """A checked schema; objects take no other properties than theirs."""

    spec: dict

    def __post_init__(self) -> None:
        _check_schema(self.spec, 0)

    def validate(self, value: object) -> object:
        """The value, if it fits; else Rejected(mismatch) with the place."""
        _check_value(self.spec, value, "$")
        return value


def _check_schema(spec: Mapping, depth: int) -> None:
    kind = spec.get("type")
    if kind not in _KEYS or depth > 16 or set(spec) - _KEYS[kind]:
        raise ValueError(f"not a schema: {spec}")
    for s in spec.get("properties", {}).values():
        _check_schema(s, depth + 1)
    if set(spec.get("required", ())) - set(spec.get("properties", {})):
        raise ValueError("a required property isn't one of the properties")
    if kind == "array":
        _check_schema(spec["items"], depth + 1)


def _check_value(spec: Mapping, v: object, at: str) -> None:
    kind = spec["type"]

    def fail(why: str) -> None:
        raise Rejected(Code.MISMATCH, f"{at}: {why}")

    fits = {"object": isinstance(v, Mapping), "array": isinstance(v, list | tuple), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "integer": isinstance(v, int) and not isinstance(v, bool), "number": isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)}
    if not fits[kind]:
        fail(f"not {kind}")
    if kind == "object":
        if extra := set(v) - set(spec.get("properties", {})):
            fail(f"unknown {sorted(extra)}")
        if missing := set(spec.get("required", ())) - set(v):
            fail(f"missing {sorted(missing)}")
        for k, x in v.items():
            _check_value(spec["properties"][k], x, f"{at}.{k}")
    elif kind == "array":
        if len(v) > spec.get("maxItems", 10_000):
            fail("too many items")
        for i, x in enumerate(v):
            _check_value(spec["items"], x, f"{at}[{i}]")
    elif kind == "string":
        if len(v) > spec.get("maxLength", 1 << 20) or ("enum" in spec and v not in spec["enum"]):
            fail("text out of bounds")
    elif kind in ("integer", "number") and not spec.get("minimum", -math.inf) <= v <= spec.get("maximum", math.inf):
        fail("number out of bounds")
