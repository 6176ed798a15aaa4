import random

from speechgrid.operators import intervals as iv


def test_islands_need_no_table_of_islands(spark):
    """Spans of equal starts, nested ones and ones over bucket edges give the islands of brute force, with no aggregation held in memory."""
    r = random.Random(8)
    spans = [(m, s, s + r.choice([1, 30, 700, 4_000])) for m in range(3) for s in (r.randint(0, 40) * 250 for _ in range(60))]
    for slack in (0, 1, 250):
        u = iv.interval_union(spark.createDataFrame(spans, "media_id bigint, start_ms bigint, end_ms bigint"), ["media_id"], slack_ms=slack, bucket_ms=1_000)
        want = []
        for m, s, e in sorted(spans):
            if want and want[-1][0] == m and s <= want[-1][2] + slack:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([m, s, e])
        assert sorted(map(list, u.collect())) == want
        assert "Aggregate" not in u._jdf.queryExecution().executedPlan().toString()
