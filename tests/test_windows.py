"""Windows that end on pauses: rows of pauses against the array form, and a span with a hundred thousand of them."""

import bisect
import random

from pyspark.sql import functions as F

from speechgrid.operators import intervals as iv


def test_rows_as_the_array_form(spark):
    r = random.Random(3)
    spans, pauses = [], []
    for i in range(80):
        a = r.randrange(0, 2_000_000)
        b = a + r.choice([1, 9_999, 10_000, 10_001, 35_000, 200_000])
        spans.append((i % 3, i, a, b))
        pauses += [(i % 3, i, r.randrange(a - 2_000, b + 2_000)) for _ in range(r.choice([0, 1, 5, 40]))]
    df = spark.createDataFrame(spans, "media_id long, turn long, start_ms long, end_ms long")
    p = spark.createDataFrame(pauses + pauses[:20], "media_id long, turn long, at_ms long")
    arrays = df.join(p.groupBy("media_id", "turn").agg(F.collect_set("at_ms").alias("p")), ["media_id", "turn"], "left").withColumn("p", F.coalesce("p", F.expr("cast(array() as array<bigint>)")))
    for least in (0, 6_000):
        want = sorted(tuple(x) for x in iv.candidate_windows(arrays, 10_000, least, "p").select("media_id", "turn", "start_ms", "end_ms").distinct().collect())
        assert sorted(tuple(x) for x in iv.windows_at_pauses(df, p, 10_000, least).distinct().collect()) == want


def test_a_span_with_a_hundred_thousand_pauses(spark):
    n = 100_000
    df = spark.createDataFrame([(1, 1, 0, 130 * n)], "media_id long, turn long, start_ms long, end_ms long")
    p = spark.range(n).select(F.lit(1).cast("long").alias("media_id"), F.lit(1).cast("long").alias("turn"), (F.col("id") * 130 + F.col("id") % 7).alias("at_ms"))
    edges = sorted({0, 130 * n} | {130 * i + i % 7 for i in range(n) if 130 * i + i % 7 > 0})
    want = [(s, e) for s in edges if (e := edges[bisect.bisect_right(edges, s + 10_000) - 1]) > s and e - s >= 6_000]
    assert sorted((x.start_ms, x.end_ms) for x in iv.windows_at_pauses(df, p, 10_000, 6_000).collect()) == want
