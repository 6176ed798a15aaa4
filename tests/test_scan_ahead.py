import random

from pyspark.sql import functions as F

from speechgrid.functions.scan import next_seen, scan


def test_next_seen_reads_no_frame_anew(spark):
    """A frame from the row to the partition's end is read again for every row, the square of a chunk's rows."""
    x = spark.range(50).selectExpr("id % 2 as k", "id as seq", "if(id % 7 = 0, id, null) as v")
    plan = scan(x, ["k"], ["seq"], F.expr("seq div 8"), a=next_seen("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_next_seen(spark):
    rng = random.Random(4)
    rows = [(k, a, b, rng.choice([None, None, None, a * 100 + (b or 0)])) for k in range(3) for a in range(40) for b in (None, 1, 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, a, -1 if b is None else b, v) for k, a, b, v in rows], "k int, a int, b int, v int")
    for chunk in (F.expr("a div 7"), None):
        got = scan(df, ["k"], ["a", "b"], chunk, here=next_seen("v"), later=next_seen("v", inclusive=False)).collect()
        for k in range(3):
            r = sorted((x for x in got if x.k == k), key=lambda x: (x.a, x.b))
            for i, x in enumerate(r):
                assert x.here == next((y.v for y in r[i:] if y.v is not None), None)
                assert x.later == next((y.v for y in r[i + 1:] if y.v is not None), None)
