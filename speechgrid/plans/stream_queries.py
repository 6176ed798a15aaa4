"""Streams over trace segments written from the supplied tables, run until the files at hand are read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_folder
from ..streaming import late
from ..streaming import trace_streams as st
from .registry import query
from .timing_queries import PACE_STEP, TAKES, takes, unit_events

M = ["media_id"]
COLS = [c.split()[0] for c in st.TRACE.split(", ")]


def folder(t, kind):
    return f"{stage_folder(t.spark)}/{kind}-{uuid.uuid4().hex}"


def filled(df):
    """``df`` with the trace's columns, those it lacks as NULLs."""
    types = dict(c.split() for c in st.TRACE.split(", "))
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in COLS])


def segments(t, df):
    """``df`` as JSON-lines segments."""
    path = folder(t, "trace")
    filled(df).write.json(path)
    return path


def calls(t):
    return t.trace.selectExpr("event_id", "t_ms", "media_id", "run_id", "event", "event_id AS id", "wall_ms", "k * 10 AS tokens", "if(k % 7 = 0, 'timeout', null) AS error", "k AS amount")


@query("stream_dedupe", "SELECT event_id, media_id, t_ms FROM fx_trace")
def _(t):
    c = calls(t)
    s = st.dedupe(st.trace_stream(t.spark, segments(t, c.unionByName(c.filter("k % 2 = 0"))), "40 days"))
    return st.run_available(s.select("event_id", "media_id", "t_ms"), folder(t, "out"))


@query("stream_usage_windows", """SELECT media_id, t_ms // 60000 * 60000 AS start_ms, COUNT(*) AS calls, COUNT(*) FILTER (k % 7 = 0) AS errors, CAST(SUM(k * 10) AS BIGINT) AS tokens, CAST(SUM(wall_ms) AS BIGINT) AS wall_ms
FROM fx_trace WHERE event = 'claude' GROUP BY media_id, t_ms // 60000""")
def _(t):
    s = st.usage_windows(st.trace_stream(t.spark, segments(t, calls(t))))
    return st.run_available(s, folder(t, "out"), "update", ["media_id", "start_ms"])


LATE_MS = 600_000


def turns_with_late(t, first, second):
    """Two turns of the usage stream; what comes late in the second is split off and its partitions recomputed."""
    spark, raw, path = t.spark, folder(t, "trace"), folder(t, "late")
    schema = T.StructType.fromDDL(st.TRACE)
    table = None
    for part in (first, second):
        filled(part).write.mode("append").json(raw)
        late.split_late(spark.readStream.schema(schema).json(raw), path, LATE_MS)
        s = st.usage_windows(late.on_time(spark, path, schema, "10 minutes"))
        table = st.run_available(s, f"{path}/stream", "update", ["media_id", "start_ms"])
    late.replace_partitions(table, f"{path}/table")
    events = spark.read.schema(schema).json(raw)
    late.recover(events, late.late_rows(spark, path, schema), f"{path}/table", st.usage_windows)
    return late.windows_table(spark, f"{path}/table", table.schema), table, late.late_rows(spark, path, schema)


@query("stream_usage_with_late_rows", """SELECT media_id, t_ms // 60000 * 60000 AS start_ms, COUNT(*) AS calls, COUNT(*) FILTER (k % 7 = 0) AS errors, CAST(SUM(k * 10) AS BIGINT) AS tokens, CAST(SUM(wall_ms) AS BIGINT) AS wall_ms
FROM fx_trace WHERE event = 'claude' GROUP BY media_id, t_ms // 60000""")
def _(t):
    c = calls(t)
    return turns_with_late(t, c.filter("event_id % 5 <> 0"), c.filter("event_id % 5 = 0"))[0]


@query("stream_recent_usage", """SELECT media_id, (t_ms // 300000 - o) * 300000 AS start_ms, COUNT(*) AS calls, COUNT(*) FILTER (k % 7 = 0) AS errors, CAST(SUM(k * 10) AS BIGINT) AS tokens, CAST(SUM(wall_ms) AS BIGINT) AS wall_ms
FROM fx_trace, (SELECT unnest(range(3)) AS o) WHERE event = 'claude' GROUP BY ALL""")
def _(t):
    s = st.usage_windows(st.trace_stream(t.spark, segments(t, calls(t))), "15 minutes", "5 minutes")
    return st.run_available(s, folder(t, "out"), "update", ["media_id", "start_ms"])


@query("stream_rolling_load", """SELECT media_id, (t_ms // 10000 + 1 + o) * 10000 AS end_ms, CAST(SUM(k) AS BIGINT) AS load FROM fx_trace, (SELECT unnest(range(6)) AS o) WHERE k > 0 GROUP BY ALL""")
def _(t):
    s = st.rolling_load(st.trace_stream(t.spark, segments(t, calls(t))), slide="10 seconds")
    return st.run_available(s, folder(t, "out"), "update", ["media_id", "end_ms"])


@query("stream_sessions", """SELECT media_id, MIN(t_ms) AS start_ms, MAX(t_ms) + 600000 AS end_ms, COUNT(*) AS events, CAST(SUM(wall_ms) AS BIGINT) AS wall_ms FROM (
  SELECT *, SUM(CASE WHEN t_ms - p < 600000 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY t_ms, event_id) AS s FROM (SELECT *, LAG(t_ms) OVER (PARTITION BY media_id ORDER BY t_ms, event_id) AS p FROM fx_trace))
GROUP BY media_id, s HAVING MAX(t_ms) + 600000 <= (SELECT MAX(t_ms) FROM fx_trace) - 600000""")
def _(t):
    s = st.sessions(st.trace_stream(t.spark, segments(t, calls(t))), "10 minutes")
    return st.run_available(s, folder(t, "out"))


LINES = """SELECT p.media_id, p.id, CASE WHEN id % 5 = 0 AND id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'pieces' ELSE 'joined' END ELSE 'whole' END AS said,
  CASE WHEN id % 5 = 0 AND id % 3 = 0 AND id % 4 = 0 THEN 0 ELSE freeze_ms END AS freeze_ms FROM fx_plans p WHERE id % 13 <> 0"""


@query("stream_current_lines", LINES)
def _(t):
    s = st.current_lines(st.trace_stream(t.spark, segments(t, unit_events(t))))
    return st.run_available(s, folder(t, "out"), "update", ["media_id", "id"]).drop("t_ms")


@query("stream_online_pace", PACE_STEP.replace("SELECT media_id, voice, 1 / GREATEST(arg_max", "SELECT voice, 1 / GREATEST(arg_max").replace("MAX(k) AS n FROM m GROUP BY media_id, voice", "MAX(k) AS n FROM m GROUP BY media_id, voice"),
       fx_takes=TAKES.replace("speaker AS voice", "media_id || '/' || speaker AS voice"))
def _(t):
    x = takes(t).selectExpr("concat(cast(media_id as string), '/', voice) AS voice", "at AS t_ms", "at AS event_id", "units", "seconds", "'take' AS event")
    s = st.online_pace(st.trace_stream(t.spark, segments(t, x)))
    return st.run_available(s, folder(t, "out"), "update", ["voice"], ["n"])
