"""Late events: split off before the watermark drops them, and the windows they belong to recomputed and replaced.

A watermark closes windows; what comes later is dropped by the stateful operators without a trace. Here a stateless query reads the
segments first and writes every micro-batch as one folder with a part for the rows on time and one for the late ones, judged by the
largest event time of all batches before. The stateful stream reads the rows on time. The late rows are a side table: it names the
partitions of the result (a hash bucket of the recording, a day) that the stream got wrong. Those are recomputed from all events by
the batch form of the same report and replace the stream's in one commit; all other partitions stay.

A batch that is run again after a failure writes the same folders anew and reads the same watermark, and replacing a partition twice
gives the same partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MS = 86_400_000


def split_late(events: DataFrame, path: str, late_ms: int, at: str = "t_ms") -> None:
    """Write what a stream (without watermark) holds now under ``path``: rows/batch=n/late=true|false, and watermark/batch=n with
    the watermark of the next batch. A row is late if its time lies over ``late_ms`` before the largest of earlier batches; rows
    without a time are on time (the windows leave them out)."""
    spark = events.sparkSession
    marks = f"{path}/watermark"
    schema = T.StructType([T.StructField("mark", T.LongType()), T.StructField("batch", T.LongType())])

    def mark_before(no: int) -> int | None:
        if no == 0:
            return None
        return spark.read.schema(schema).parquet(marks).filter(F.col("batch") < no).agg(F.max("mark")).first()[0]

    def put(batch: DataFrame, no: int) -> None:
        mark = mark_before(no)
        late = F.lit(False) if mark is None else F.coalesce(F.col(at) < mark, F.lit(False))
        folder = f"{path}/rows/batch={no}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(folder)
        top = batch.sparkSession.read.schema(batch.schema).parquet(folder).agg(F.max(at)).first()[0]
        now = max((m for m in (mark, None if top is None else top - late_ms) if m is not None), default=None)
        spark.createDataFrame([(now,)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={no}")

    q = events.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()


def _rows_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())])


def on_time(spark: SparkSession, path: str, schema: T.StructType, late: str, at: str = "t_ms") -> DataFrame:
    """The rows on time as a stream with event time ``ts`` and a watermark. Run it after ``split_late`` in the same turn: then its
    own watermark, from turns before, is never ahead of the one the rows were judged by, and no row is dropped."""
    rows = spark.readStream.schema(_rows_schema(schema)).parquet(f"{path}/rows").filter("NOT late").drop("batch", "late")
    return rows.withColumn("ts", F.timestamp_millis(at)).withWatermark("ts", late)


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The side table of late rows."""
    return spark.read.schema(_rows_schema(schema)).parquet(f"{path}/rows").filter("late").drop("late")


def partition_of(media: str, at: str, buckets: int) -> dict[str, Column]:
    """The partition of a window that starts at, or holds, a time; windows must not cross midnight."""
    return {"bucket": F.pmod(F.xxhash64(media), F.lit(buckets)).cast("int"), "day": F.floor(F.col(at) / DAY_MS).cast("int")}


def replace_partitions(df: DataFrame, path: str, media: str = "media_id", at: str = "start_ms", buckets: int = 64) -> None:
    """Write windows to the result table; only the partitions present are replaced, in one commit."""
    x = df.withColumns(partition_of(media, at, buckets))
    x.hint("rebalance", "bucket", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "day").parquet(path)


def recover(events: DataFrame, late: DataFrame, path: str, report: Callable[[DataFrame], DataFrame], media: str = "media_id", event_at: str = "t_ms", at: str = "start_ms", buckets: int = 64) -> None:
    """Recompute the partitions of the table that ``late`` rows touch, by ``report`` over all ``events`` of those partitions, and
    replace them. Without late rows nothing is written. Run it after the stream's windows were written, with all late rows so far:
    the stream never learns of them, so its own form of such a partition stays wrong."""
    part = partition_of(media, event_at, buckets)
    touched = late.filter(F.col(event_at).isNotNull()).select(*[c.alias(n) for n, c in part.items()]).distinct()
    if touched.isEmpty():
        return
    whole = events.withColumns(part).join(touched, [*part], "left_semi").drop(*part)
    replace_partitions(report(whole.withColumn("ts", F.timestamp_millis(event_at))), path, media, at, buckets)


def windows_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("day", T.IntegerType())])).parquet(path).drop("bucket", "day")
