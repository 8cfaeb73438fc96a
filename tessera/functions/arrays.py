"""Columns over arrays and strings of places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorting_order(values: Column) -> Column:
    """Places, from 0, of an array's values in ascending order; ties by place, nulls and NaN last."""
    placed = F.transform(values, lambda v, i: F.struct(v.isNull().alias("n"), v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(placed), lambda s: s["i"])


def inverse_permutation(order: Column) -> Column:
    """The array that puts ``order`` (of places from 0) back: the order that sorts it."""
    return sorting_order(order)


def stacked(*rows: Column) -> Column:
    """Arrays of one length as an array of columns; shorter ones are filled up with nulls."""
    return F.transform(F.arrays_zip(*[r.alias(f"_{i}") for i, r in enumerate(rows)]), lambda s: F.array(*[s[f"_{i}"] for i in range(len(rows))]))


def hamming(a: Column, b: Column) -> Column:
    """Places where two strings of one length differ; null for different lengths."""
    apart = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(apart, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))))


def parsed_change(text: Column, letters: str) -> Column:
    """``wt, pos, mt`` of a change such as ``A12V``; null where the text is none."""
    pattern = f"^([{letters}])([1-9][0-9]{{0,8}})([{letters}])$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(F.rlike(text, F.lit(pattern)), F.struct(part(1).alias("wt"), part(2).cast("int").alias("pos"), part(3).alias("mt")))
