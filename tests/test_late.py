"""Late events: split by the watermark of earlier batches, recovered into the windows they belong to."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechgrid.plans import stream_queries as q
from speechgrid.session import stage_folder
from speechgrid.sources.fixtures import Tables
from speechgrid.streaming import late
from speechgrid.streaming import trace_streams as st


def rows(df):
    return sorted(tuple(r) for r in df.select("media_id", "start_ms", "calls", "errors", "tokens", "wall_ms").collect())


def test_late_rows_are_split_and_recovered(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    c = q.calls(t)
    merged, stream, side = q.turns_with_late(t, c.filter("event_id % 5 <> 0"), c.filter("event_id % 5 = 0"))
    want = rows(st.usage_windows(c.withColumn("ts", F.timestamp_millis("t_ms"))))
    second = c.filter("event_id % 5 = 0").count()
    assert 0 < side.count() < second + 1 and rows(stream) != want
    assert rows(merged) == want


def test_on_time_late_and_timeless_rows(spark):
    path, raw = (f"{stage_folder(spark)}/{k}-{uuid.uuid4().hex}" for k in ("late", "raw"))
    schema = T.StructType.fromDDL(st.TRACE)
    turns = [[(1, 1_000_000, 7), (2, 5_000_000, 7)], [(3, 4_400_000, 7), (4, 4_399_999, 7), (5, None, 7), (6, 100, 8)], [(7, 4_500_000, 8)], [(8, 9_000_000, 8)], [(9, 8_400_000, 7), (10, 8_399_999, 7)]]
    for part in turns:
        q.filled(spark.createDataFrame(part, "event_id long, t_ms long, media_id long").withColumns({"event": F.lit("claude"), "wall_ms": F.lit(5).cast("long")})).coalesce(1).write.mode("append").json(raw)
        late.split_late(spark.readStream.schema(schema).json(raw), path, 600_000)
        table = st.run_available(st.usage_windows(late.on_time(spark, path, schema, "10 minutes")), f"{path}/stream", "update", ["media_id", "start_ms"])
    side = late.late_rows(spark, path, schema)
    assert sorted(r.event_id for r in side.collect()) == [4, 6, 10]
    events = spark.read.schema(schema).json(raw)
    want = rows(st.usage_windows(events.filter("t_ms is not null").withColumn("ts", F.timestamp_millis("t_ms"))))
    late.replace_partitions(table, f"{path}/table", buckets=4)
    kept = [r for r in want if r[0] == 7]
    for _ in range(2):  # a second recovery changes nothing
        late.recover(events, side, f"{path}/table", st.usage_windows, buckets=4)
        got = rows(late.windows_table(spark, f"{path}/table", table.schema))
        assert got == want and kept
    late.recover(events, side.limit(0), f"{path}/none", st.usage_windows)
