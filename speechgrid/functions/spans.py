"""Time buckets: the join key that keeps interval joins from being quadratic inside one recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_MS = 60_000


def bucket_of(ms, width: int) -> Column:
    """The bucket a time falls in, as BIGINT (exact integer arithmetic, negatives included)."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return ((c - F.pmod(c, F.lit(width))) / F.lit(width)).cast("bigint")


def buckets(start: Column, end: Column, width: int) -> Column:
    """All buckets a half-open span touches (an empty span touches the one it starts in)."""
    return F.sequence(bucket_of(start, width), F.greatest(bucket_of(start, width), bucket_of(end - 1, width)))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], width: int = BUCKET_MS, prefix: str = "b_",
                 a_span=("start_ms", "end_ms"), b_span=("start_ms", "end_ms")) -> DataFrame:
    """Pairs of rows whose half-open spans share time, each pair once. Columns of ``b`` other than the keys get
    ``prefix``; ``overlap_ms`` is added.

    Both sides are exploded to the buckets they touch and equi-joined on (on, bucket), so a recording that holds most of
    the rows is spread over its buckets. A pair that meets in several buckets is kept in the first of them."""
    bs, be = (prefix + c for c in b_span)
    rb = b.select(*on, *[F.col(c).alias(prefix + c) for c in b.columns if c not in on])
    ax = a.withColumns({"__a0": bucket_of(a_span[0], width),
                        "__b": F.explode(buckets(F.col(a_span[0]), F.col(a_span[1]), width))})
    bx = rb.withColumns({"__b0": bucket_of(bs, width), "__b": F.explode(buckets(F.col(bs), F.col(be), width))})
    j = ax.join(bx, [*on, "__b"]).filter(
        (F.col(a_span[0]) < F.col(be)) & (F.col(bs) < F.col(a_span[1]))
        & (F.col("__b") == F.greatest("__a0", "__b0")))
    return j.select(*a.columns, *[c for c in rb.columns if c not in on],
                    (F.least(F.col(a_span[1]), F.col(be)) - F.greatest(F.col(a_span[0]), F.col(bs))).alias("overlap_ms"))


def point_join(points: DataFrame, spans: DataFrame, on: list[str], at: str, near_ms: int = 0, width: int = BUCKET_MS,
               prefix: str = "b_", span=("start_ms", "end_ms")) -> DataFrame:
    """Pairs of a point and a span no more than ``near_ms`` from it (closed ends). Only spans are exploded; a point
    stays one row."""
    bs, be = (prefix + c for c in span)
    rb = spans.select(*on, *[F.col(c).alias(prefix + c) for c in spans.columns if c not in on])
    bx = rb.withColumn("__b", F.explode(buckets(F.col(bs) - near_ms, F.col(be) + near_ms + 1, width)))
    px = points.withColumn("__b", bucket_of(at, width))
    return (px.join(bx, [*on, "__b"])
            .filter((F.col(at) >= F.col(bs) - near_ms) & (F.col(at) <= F.col(be) + near_ms)).drop("__b"))
