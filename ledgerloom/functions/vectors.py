"""Distances and arithmetic of vectors in array columns, in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / F.when(size > 0, size))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)


def normalize(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(_double(a), lambda x: x / size))


def slice_of(a: Column, start: int, end: int) -> Column:
    """Elements start to end - 1, counted from 0."""
    return F.slice(a, start + 1, end - start)


def quantize_binary(a: Column) -> Column:
    """One bit for each element: is it positive?  As an array of 0 and 1."""
    return F.transform(a, lambda x: F.when(x > 0, 1).otherwise(0))


def quantize_int8(a: Column, low: float = -1.0, high: float = 1.0) -> Column:
    step = (high - low) / 255
    return F.transform(_double(a), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor((x - low) / step) - 128)).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def to_json(a: Column) -> Column:
    return F.to_json(a)
