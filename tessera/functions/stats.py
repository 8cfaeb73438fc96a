"""Expressions and aggregates for correlations, reliability and tail probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import value_ranks


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pearson(x: str | Column, y: str | Column, w: str | Column | None = None) -> Column:
    """Aggregate: (weighted) correlation over rows where both are present; null where either has no variance."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    if w is None:
        x, y = F.when(both, x), F.when(both, y)
        lone = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        return F.when(~lone, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    w = F.when(both, _col(w).cast("double"))
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - F.try_divide(sx * sy, n)
    vx, vy = F.sum(w * x * x) - F.try_divide(sx * sx, n), F.sum(w * y * y) - F.try_divide(sy * sy, n)
    live = F.when(w > 0, x), F.when(w > 0, y)
    lone = (F.min(live[0]) == F.max(live[0])) | (F.min(live[1]) == F.max(live[1]))
    return F.when(~lone, F.try_divide(cov, F.sqrt(vx * vy)))


def order_free_sum(value: str | Column) -> Column:
    """Aggregate: a sum that does not depend on the rows' order, so that equal groups tie; values are added as decimals.

    Where a value does not fit (from 1e18 on, NaN), doubles are added as they come; digits beyond the tenth are rounded.
    """
    v = _col(value).cast("double")
    d = v.try_cast("decimal(28,10)")
    return F.coalesce(F.when(F.count(d) == F.count(v), F.sum(d)).cast("double"), F.sum(v))


def pearson_sql(x: str, y: str) -> str:
    """The same aggregate in DuckDB SQL, for columns without nulls."""
    return f"CASE WHEN min({x}) = max({x}) OR min({y}) = max({y}) THEN NULL ELSE covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


def spearman_brown(r: Column, k: int | Column = 2) -> Column:
    """Reliability of a test ``k`` times as long; null from r <= -1."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(r > -1, F.try_divide(k * r, 1 + (k - 1) * r))


def paired_ranks(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with average ranks ``ry`` and ``rp`` of two columns (rows without either are dropped)."""
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    ry = value_ranks(df, y, by, "ry").drop("ry_min", "ry_n").withColumnRenamed("ry_avg", "ry")
    rp = value_ranks(df, p, by, "rp").drop("rp_min").withColumnsRenamed({"rp_avg": "rp", "rp_n": "n_ranked"})
    return df.join(ry, [*(by or []), y]).join(rp, [*(by or []), p])


def auroc(rank: str = "rp", label: str = "bin") -> Column:
    """Aggregate over average ranks of the prediction: the Mann-Whitney share, ties one half; null with one class."""
    pos = F.sum(_col(label).cast("double"))
    neg = F.count("*") - pos
    return F.try_divide(F.sum(F.when(_col(label) == 1, _col(rank))) - pos * (pos + 1) / 2, pos * neg)


def chi2_upper(x: float, k: int) -> float:
    """P(chi-squared with ``k`` degrees > x), by the series or continued fraction of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
