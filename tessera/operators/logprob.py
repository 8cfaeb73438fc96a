"""Array expressions on log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_softmax(values: Column) -> Column:
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(values, lambda x: x - top - F.log(total))


def entropy(logp: Column, least: float = 1e-12) -> Column:
    """Shannon entropy in nats after renormalising, probabilities clipped from below."""
    total = F.aggregate(logp, F.lit(0.0), lambda a, x: a + F.exp(x))
    p = F.transform(logp, lambda x: F.greatest(F.exp(x) / total, F.lit(least)))
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(x))


def window_starts(length: Column, n: int, width: int) -> Column:
    """``n`` evenly spaced starts, rounded half to even, of windows that cover ``length``; ``[0]`` if one is enough."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (length - width) / float(n - 1), 0).cast("int"))
    return F.when(length <= width, F.array(F.lit(0))).otherwise(spaced)
