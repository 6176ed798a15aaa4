"""Vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit_vector(v) -> Column:
    """``v`` at length one; NULL when missing, empty, not finite or zero."""
    v = F.col(v) if isinstance(v, str) else v
    d = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    ok = d.isNotNull() & (F.size(d) > 0) & ~bad
    return F.when(ok, F.when(n > 1e-8, F.transform(d, lambda x: x / n)))
