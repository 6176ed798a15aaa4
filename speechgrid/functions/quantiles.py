"""Exact quantiles of groups of any size, in two passes: a histogram says which bucket holds a rank, and only that bucket is ranked.

The percentile aggregate keeps a map of all distinct values of a group in one task, so a recording with a third of all rows is one
task. Here equal values are counted where they lie, and the counts are spread by (group, value). Buckets are cut by value at equal
depth over all groups together, from a mergeable sketch, so that no bucket of any group holds more than its share of all the
counts, however large the group and however its values cluster. Per group only its buckets are ordered (at most ``_MOST`` of them);
the buckets that hold a wanted rank are fetched by (group, bucket) and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

_MOST = 1024


def _cut(counts: DataFrame, bucket_rows: int) -> DataFrame:
    """The counts with ``__b``, a bucket that never decreases with the value of a measure."""
    many = min(_MOST, -(-counts.count() // bucket_rows))
    if many < 2:
        return counts.withColumn("__b", F.lit(0))
    cuts = counts.groupBy("__m").agg(F.percentile_approx("__v", [k / many for k in range(1, many)], 8 * many).alias("__cuts"))
    # one row a measure, of at most _MOST numbers: bounded whatever the data
    halves = f"transform(sequence(1, {_MOST.bit_length() - 1}), k -> cast(power(2, {_MOST.bit_length() - 1} - k) as int))"
    find = F.expr(f"aggregate({halves}, 0, (at, half) -> if(coalesce(get(__cuts, at + half - 1) <= __v, false), at + half, at))")
    return counts.join(F.broadcast(cuts), "__m").withColumn("__b", find).drop("__cuts")


def quantiles(df: DataFrame, by: list[str], measures: dict[str, tuple[Column, dict[str, float]]], bucket_rows: int = 200_000, fused: bool = False) -> DataFrame:
    """(by, one column a quantile): of each measure ``name: (column, {result: share})`` the value at ``share`` of its non-NULL values
    in order, between two values in proportion, as the percentile aggregate gives it; NULL without values. Groups without any value
    have no row. ``by`` must not be NULL. ``fused``: between two values the lower one's part is multiplied and added in one rounding,
    as the comparison SQL's ``quantile_cont`` does; the percentile aggregate rounds once more, so its last bit may differ."""
    values = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), c.cast("double").alias("v")) for m, (c, _) in measures.items()]), lambda x: x["v"].isNotNull())
    counts = stage(df.select(*by, F.explode(values).alias("x")).groupBy(*by, F.col("x.m").alias("__m"), F.col("x.v").alias("__v")).agg(F.count("*").alias("__n")))
    cut = _cut(counts, bucket_rows)
    key, bucket = [*by, "__m"], [*by, "__m", "__b"]
    w = Window.partitionBy(*key)
    held = cut.groupBy(*bucket).agg(F.sum("__n").alias("__held")).withColumns({
        "__upto": F.sum("__held").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__held").over(w)})
    # the ranks (from 0) of both neighbours of each wanted place
    asked = F.create_map(*[x for m, (_, ps) in measures.items() for x in (F.lit(m), F.array(*[F.struct(F.lit(r).alias("r"), F.lit(float(p)).alias("p")) for r, p in ps.items()]))])
    at = F.col("q.p") * (F.col("__all") - 1)
    ranks = (held.withColumn("q", F.explode(F.element_at(asked, F.col("__m")))).withColumn("__at", at)
             .withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))))
             .filter("__rank < __upto AND __rank >= __upto - __held")
             .select(*bucket, F.col("q.r").alias("__r"), "__at", "__rank", (F.col("__rank") - F.col("__upto") + F.col("__held")).alias("__in")))
    ranks = stage(ranks)
    upto = F.sum("__n").over(Window.partitionBy(*bucket).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ordered = cut.join(ranks.select(*bucket).distinct(), bucket, "left_semi").withColumn("__upto", upto)
    found = ordered.join(ranks, bucket).filter("__in < __upto AND __in >= __upto - __n")
    low, high = F.min("__v"), F.max("__v")
    each = found.groupBy(*by, "__r").agg(low.alias("__low"), high.alias("__high"), F.first("__at").alias("__at"))
    lower, upper = F.floor("__at"), F.ceil("__at")
    if fused:
        between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col("__low"), upper - F.col("__at"), (F.col("__at") - lower) * F.col("__high")).cast("double")
        value = F.when(lower == upper, F.col("__low")).otherwise(between)
    else:
        value = F.when((lower == upper) | (F.col("__low") == F.col("__high")), F.col("__low")).otherwise(
            (upper - F.col("__at")) * F.col("__low") + (F.col("__at") - lower) * F.col("__high"))
    each = each.withColumn("__value", value)
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("__r") == r, F.col("__value"))).alias(r) for _, ps in measures.values() for r in ps])
