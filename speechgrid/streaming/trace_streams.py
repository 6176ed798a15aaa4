"""Trace events as a stream: de-duplication, windows, rolling load, sessions, current lines and online pace.

Events carry their time ``t_ms``; the watermark says how late one may be. What comes later is dropped here; ``late`` splits it off
before and recomputes the windows it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import pace

cloudpickle.register_pickle_by_value(pace)

TRACE = ("event_id bigint, t_ms bigint, media_id bigint, run_id string, event string, id bigint, provider string, error string, wall_ms bigint, "
         "tokens bigint, amount bigint, outcome string, said string, freeze_ms bigint, voice string, units double, seconds double")


def trace_stream(spark: SparkSession, folder: str, late: str = "10 minutes", schema: str = TRACE, max_files: int | None = None) -> DataFrame:
    """A folder of finished JSON-lines segments as a stream, with event time ``ts`` and a watermark."""
    r = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(folder).withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", late)


def dedupe(events: DataFrame) -> DataFrame:
    """Each event once, however often a resumed run repeats it inside the watermark."""
    return events.dropDuplicatesWithinWatermark(["media_id", "run_id", "event", "id", "t_ms"])


def usage_windows(events: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Model calls, errors, tokens and wall time per recording and window; a slide makes it a rolling window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (events.filter("event = 'claude'").groupBy("media_id", w.alias("w")).agg(
        F.count("*").alias("calls"), F.count("error").alias("errors"), F.sum("tokens").alias("tokens"), F.sum("wall_ms").alias("wall_ms"))
        .select("media_id", F.unix_millis("w.start").alias("start_ms"), "calls", "errors", "tokens", "wall_ms"))


def rolling_load(events: DataFrame, width: str = "60 seconds", slide: str = "1 second") -> DataFrame:
    """Added time per recording in every minute ending on a whole second (the exact batch form is ``intervals.rolling_load``)."""
    return (events.filter("amount > 0").groupBy("media_id", F.window("ts", width, slide).alias("w")).agg(F.sum("amount").alias("load"))
            .select("media_id", F.unix_millis("w.end").alias("end_ms"), "load"))


def sessions(events: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Stretches of activity per recording, closed by a minute of silence."""
    return (events.groupBy("media_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("wall_ms").alias("wall_ms"))
            .select("media_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "events", "wall_ms"))


def current_lines(events: DataFrame) -> DataFrame:
    """The current state of each line, emitted again whenever it changes: its latest unit, with the latest wording and the latest
    freeze that replacing rephrases give, in whatever order the events come; an override that comes first waits in the state.

    Maxima by (t_ms, event_id), kept as one streaming aggregation in the JVM: a few numbers and two strings a line, with no call of
    Python a line. A line's state is kept as long as the stream, so no override is lost for coming late."""
    x = events.filter("event = 'unit' or (event = 'rephrase' and outcome = 'replaced')")
    at, unit = F.struct("t_ms", "event_id"), F.col("event") == "unit"
    g = x.groupBy("media_id", "id").agg(
        F.max_by(F.struct("said", "freeze_ms", "t_ms"), F.when(unit, at)).alias("u"),
        *[F.max_by(c, F.when(~unit & F.col(c).isNotNull(), at)).alias(f"o_{c}") for c in ("said", "freeze_ms")])
    return g.filter("u is not null").select("media_id", "id", F.coalesce("o_said", "u.said").alias("said"),
                                            F.coalesce("o_freeze_ms", "u.freeze_ms").alias("freeze_ms"), F.col("u.t_ms").alias("t_ms"))


PACE_STATE = "inv double, ov double, p0 double, p1 double, p2 double, p3 double, n bigint"
PACE_OUT = "voice string, rate double, overhead double, n bigint"


def _pace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = pace.Model(*state.get) if state.exists else pace.Model()
    got = pd.concat(list(batches)).sort_values(["t_ms", "event_id"])
    for units, seconds in zip(got["units"], got["seconds"]):
        m.observe(float(units), float(seconds))
    state.update(m.row())
    yield pd.DataFrame({"voice": [key[0]], "rate": [m.rate()], "overhead": [m.ov], "n": [m.n]})


def online_pace(events: DataFrame) -> DataFrame:
    """Each voice's pace after every batch of its takes (the batch form is ``timing.online_pace``)."""
    x = events.filter("event = 'take'").select("voice", "t_ms", "event_id", "units", "seconds")
    return x.groupBy("voice").applyInPandasWithState(_pace, PACE_OUT, PACE_STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, mode: str = "append", key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Process what is there now and return what was written under ``path``. Each batch has a folder of its own, which a batch run
    again after a failure writes anew; with ``key`` the last row of each key is kept."""
    spark = df.sparkSession

    def put(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={no}")

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start())
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/data")
    if key is None:
        return out.drop("batch")
    from ..sources.io import latest_by_key
    return latest_by_key(out, key, ["batch", *(order or [])]).drop("batch")
