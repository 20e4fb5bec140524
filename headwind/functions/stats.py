"""Aggregate expressions for correlation, hit rate and conditional means."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both sides are known; NULL below two rows or on a constant side."""
    both = x.isNotNull() & y.isNotNull()
    xv, yv = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(xv, yv), F.stddev_pop(xv) * F.stddev_pop(yv))


def corr_from_moments(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from plain sums; NULL when a side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def hit_rate(a: Column, b: Column) -> Column:
    """Share of rows, in percent, where two directions agree."""
    return F.avg((a == b).cast("double")) * 100


def sign3(x: Column) -> Column:
    """1 / -1 / 0; NULL counts as 0."""
    return F.coalesce(F.signum(x), F.lit(0.0)).cast("int")


def avg_where(condition: Column, x: Column) -> Column:
    return F.avg(F.when(condition, x))


def t_statistic(r: Column, n: Column) -> Column:
    return F.try_divide(r * F.sqrt(n - 2), F.sqrt(1 - r * r))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(abs(1.0 - (a + b) * x / (a + 1)), tiny)
    total = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * total / a


@F.pandas_udf(DoubleType())
def student_two_sided(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two-sided p of Student's t with ``df`` degrees of freedom; meant for result rows, not for data rows."""
    for t, df in batches:
        yield pd.Series(
            [
                None if pd.isna(tv) or pd.isna(dv) or dv <= 0 else _incomplete_beta(dv / 2, 0.5, dv / (dv + tv * tv))
                for tv, dv in zip(t, df)
            ],
            dtype="float64",
        )
