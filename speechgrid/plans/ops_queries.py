"""Trace, usage and operations reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ops
from .interval_queries import islands
from .registry import query

M = ["media_id"]
NOW = 1_706_400_000_000

RUNS = """SELECT event_id, t_ms, media_id, 'r' || (k % 4) AS run_id, CASE WHEN k = 7 AND media_id % 5 <> 0 THEN 'run_start' WHEN k % 50 = 1 THEN 'run_end'
  WHEN event = 'stage_timing' AND event_id % 2 = 0 THEN 'stage_start' ELSE event END AS event, wall_ms, k, event_id % 40 AS id,
  CASE k % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' END AS provider, CASE WHEN k % 2 = 0 THEN 'claude-x' ELSE 'gpt' END AS model,
  CASE event_id % 3 WHEN 0 THEN 'translate' WHEN 1 THEN 'review' END AS call, CASE WHEN k % 7 = 0 THEN 'timeout' WHEN k % 11 = 0 THEN 'limit' END AS error,
  CAST(k * 10 AS BIGINT) AS input_tokens, CAST(k AS BIGINT) AS cache_read_tokens, CAST(k * 2 AS BIGINT) AS cache_creation_tokens,
  CAST(k * 3 AS BIGINT) AS output_tokens, CASE event_id % 4 WHEN 0 THEN 'translate' WHEN 1 THEN 'transcript' WHEN 2 THEN 'export' END AS stage,
  CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'done' END AS outcome, CASE event_id % 5 WHEN 0 THEN 'decode' ELSE 'vocode' END AS operation,
  CAST(wall_ms AS DOUBLE) AS run_ms, CAST(CASE WHEN k % 9 = 0 THEN NULL ELSE k END AS DOUBLE) AS wait_ms,
  CASE WHEN k % 8 = 0 THEN NULL WHEN k % 2 = 0 THEN 'C' ELSE 'P' END AS coverage_voiced, CASE WHEN k % 6 = 0 THEN NULL ELSE 'review' END AS verdict_by FROM {src}"""


def runs(t):
    t.trace.createOrReplaceTempView("__trace")
    return t.spark.sql(RUNS.format(src="__trace"))


START = "SELECT media_id, arg_max(run_id, (t_ms, event_id)) AS run_id, MAX(t_ms) AS t_ms FROM fx_runs WHERE event = 'run_start' GROUP BY media_id"
SCOPE = f"""SELECT r.*, CASE WHEN s.media_id IS NULL THEN 'recent_window_without_run_boundary' ELSE 'latest_run' END AS scope,
  COALESCE(s.t_ms, {NOW} - 900000000) AS since_ms FROM fx_runs r LEFT JOIN fx_start s ON s.media_id = r.media_id
  WHERE r.t_ms >= COALESCE(s.t_ms, {NOW} - 900000000) AND r.t_ms <= {NOW} AND (s.media_id IS NULL OR r.run_id = s.run_id)"""
RV = dict(fx_runs=RUNS.format(src="fx_trace"), fx_start=START, fx_scope=SCOPE)
WIN = 900_000_000


@query("latest_run_scope", "SELECT media_id, scope, since_ms, COUNT(*) AS events, CAST(SUM(wall_ms) AS BIGINT) AS wall_ms FROM fx_scope GROUP BY ALL", **RV)
def _(t):
    return (ops.latest_run(runs(t), NOW, window_ms=WIN).groupBy("media_id", "scope", "since_ms")
            .agg(F.count("*").alias("events"), F.sum("wall_ms").alias("wall_ms")))


USE_SPANS = f"""SELECT media_id, provider, model, call, GREATEST(0, t_ms - wall_ms) AS start_ms, LEAST({NOW}, t_ms) AS end_ms FROM fx_calls WHERE wall_ms > 0 AND t_ms - wall_ms < {NOW}"""
CALLS = """SELECT * REPLACE (COALESCE(provider, 'legacy') AS provider, COALESCE(call, 'unknown') AS call, wall_ms * 20 AS wall_ms) FROM fx_runs WHERE event = 'claude'"""
UKEY = "media_id, provider, model, call"
USAGE = f"""SELECT a.*, COALESCE(u.active_ms, 0) AS active_ms, COALESCE(e.errors, MAP {{}}) AS errors FROM (SELECT *, CASE WHEN total_input_tokens > 0 THEN cached_tokens::DOUBLE / total_input_tokens END AS cached_fraction FROM (
 SELECT *, CASE WHEN provider = 'codex' THEN input_tokens WHEN provider = 'claude' OR model LIKE 'claude-%' THEN input_tokens + cached_tokens + made END AS total_input_tokens FROM (
 SELECT {UKEY}, COUNT(*) AS calls, quantile_cont(wall_ms, 0.5) AS p50_ms, MAX(wall_ms) AS max_ms, COUNT(*) FILTER (error IS NULL) AS successful_calls,
   quantile_cont(wall_ms, 0.5) FILTER (error IS NULL) AS successful_p50_ms, MAX(wall_ms) FILTER (error IS NULL) AS successful_max_ms, CAST(SUM(wall_ms) AS BIGINT) AS summed_ms,
   CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(cache_read_tokens) AS BIGINT) AS cached_tokens, CAST(SUM(cache_creation_tokens) AS BIGINT) AS made FROM fx_calls GROUP BY {UKEY}))) a
LEFT JOIN (SELECT {UKEY}, CAST(SUM(end_ms - start_ms) AS BIGINT) AS active_ms FROM fx_useu GROUP BY {UKEY}) u USING ({UKEY})
LEFT JOIN (SELECT {UKEY}, map_from_entries(list((error, n) ORDER BY error)) AS errors FROM (SELECT {UKEY}, error, COUNT(*) AS n FROM fx_calls WHERE error IS NOT NULL GROUP BY ALL) GROUP BY {UKEY}) e USING ({UKEY})"""
UV = dict(RV, fx_calls=CALLS, fx_usespan=USE_SPANS, fx_useu=islands("fx_usespan", by=UKEY), fx_usage=USAGE)


@query("call_usage", "SELECT * EXCLUDE (made, errors), array_to_string(map_values(errors), ',') AS errors FROM fx_usage", **UV)
def _(t):
    x = ops.call_usage(runs(t).withColumn("wall_ms", F.col("wall_ms") * 20), M, 0, NOW)
    return x.withColumn("errors", F.concat_ws(",", F.transform(F.map_values("errors"), lambda n: n.cast("string"))))


@query("stage_table", f"""SELECT s.media_id, s.stage, COALESCE(f.wall_ms, {NOW} - s.start_ms) AS wall_ms, COALESCE(f.outcome, 'in_progress') AS outcome
FROM (SELECT media_id, stage, MAX(t_ms) AS start_ms FROM fx_runs WHERE event = 'stage_start' AND stage IS NOT NULL GROUP BY ALL) s
LEFT JOIN (SELECT media_id, stage, arg_max(wall_ms, (t_ms, event_id)) AS wall_ms, arg_max(outcome, (t_ms, event_id)) AS outcome FROM fx_runs WHERE event = 'stage_timing'
  AND stage IS NOT NULL GROUP BY ALL) f USING (media_id, stage)""", **RV)
def _(t):
    return ops.stage_table(runs(t).filter("stage is not null"), NOW)


@query("final_units", """WITH u AS (SELECT media_id, id, arg_max(COALESCE(coverage_voiced, 'unknown'), (t_ms, event_id)) AS c, arg_max(COALESCE(verdict_by, 'unknown'), (t_ms, event_id)) AS v
  FROM fx_runs WHERE event = 'unit' GROUP BY ALL)
SELECT media_id, COUNT(u.id) AS units, COALESCE(ANY_VALUE(s.n), 0) AS skipped, COUNT(*) FILTER (c = 'C') AS complete, COUNT(*) FILTER (c = 'P') AS partial, COUNT(*) FILTER (v = 'review') AS reviewed
FROM u FULL JOIN (SELECT media_id, COUNT(*) AS n FROM fx_runs WHERE event = 'skipped' GROUP BY ALL) s USING (media_id) GROUP BY media_id""", **RV)
def _(t):
    x = ops.final_units(runs(t))
    get = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return x.select("media_id", "units", "skipped", get("by_class", "C").alias("complete"), get("by_class", "P").alias("partial"),
                    get("by_source", "review").alias("reviewed"))


@query("gpu_work", """SELECT media_id, COALESCE(stage, 'unknown') AS stage, operation, COUNT(*) AS calls, SUM(run_ms) AS run_ms, SUM(COALESCE(wait_ms, 0)) AS wait_ms
FROM fx_runs WHERE event = 'gpu_work' GROUP BY media_id, COALESCE(stage, 'unknown'), operation""", **RV)
def _(t):
    return ops.gpu_work(runs(t))


@query("progress_delta", f"""SELECT a.media_id, a.stage, a.done - b.done AS advanced, 60000 AS interval_ms, (a.done - b.done) * 1000.0::DOUBLE / 60000 AS per_second, 'lines' AS unit
FROM (SELECT media_id, stage, COUNT(*) AS done, MAX(k) // 10 AS total, MAX(run_id) AS run_id FROM fx_runs WHERE stage IS NOT NULL GROUP BY ALL) a JOIN
  (SELECT media_id, stage, COUNT(*) AS done, MAX(k) // 10 AS total, MAX(run_id) AS run_id FROM fx_runs WHERE stage IS NOT NULL AND event_id % 3 <> 0 GROUP BY ALL) b USING (media_id, stage)
WHERE a.total = b.total AND a.run_id = b.run_id AND a.done >= b.done""", **RV)
def _(t):
    r = runs(t).filter("stage is not null")

    def snap(df, at):
        return df.groupBy("media_id", "stage").agg(F.count("*").alias("done"), F.expr("max(k) div 10").alias("total"), F.max("run_id").alias("run_id")).withColumns(
            {"unit": F.lit("lines"), "observed_ms": F.lit(at).cast("bigint")})
    return ops.progress_delta(snap(r, NOW), snap(r.filter("event_id % 3 <> 0"), NOW - 60_000))


@query("render_metrics", """WITH s AS (SELECT media_id, stage, arg_max(wall_ms / 1000.0::DOUBLE, (t_ms, event_id)) AS seconds, arg_max(k / 10.0::DOUBLE, (t_ms, event_id)) AS gpu_s,
   arg_max(k % 2 = 0, (t_ms, event_id)) AS cached FROM fx_runs WHERE event = 'stage_timing' GROUP BY ALL),
a AS (SELECT media_id, COUNT(*) AS stages, COUNT(*) FILTER (cached) AS cached_stages, SUM(seconds) AS seconds, SUM(gpu_s) AS gpu_s FROM s GROUP BY media_id),
c AS (SELECT media_id, COUNT(*) AS calls, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
   CAST(SUM(output_tokens) AS BIGINT) AS output_tokens FROM fx_runs WHERE event = 'claude' GROUP BY media_id)
SELECT media_id, stages, cached_stages, seconds, gpu_s, calls, input_tokens, cache_read_tokens, output_tokens, gpu_s * 1000 / d.duration_ms AS gpu_s_per_video_s
FROM a FULL JOIN c USING (media_id) LEFT JOIN fx_durations d USING (media_id)""", **RV)
def _(t):
    r = runs(t).withColumns({"event": F.expr("if(event = 'stage_timing', 'stage', event)"), "seconds": F.expr("wall_ms / 1000D"),
                             "gpu_s": F.expr("k / 10D"), "cached": F.expr("k % 2 = 0")})
    return ops.render_metrics(r, t.durations)


@query("library_snapshot", """WITH e AS (SELECT media_id, event_id, t_ms, event, run_id, id, run_ms FROM fx_scope),
j AS (SELECT media_id, MIN(t_ms) AS queued_ms, MAX(t_ms) AS updated_ms FROM fx_runs GROUP BY media_id)
SELECT j.media_id, 'running' AS status, j.queued_ms, j.updated_ms, COALESCE(ANY_VALUE(sc.scope), 'recent_window_without_run_boundary') AS scope, MIN(sc.since_ms) AS since_ms,
  COUNT(sc.event_id) AS events, COUNT(*) FILTER (sc.event = 'claude') AS calls, COALESCE(SUM(sc.run_ms) FILTER (sc.event = 'gpu_work'), 0) AS gpu_run_ms,
  COUNT(DISTINCT CASE WHEN sc.event = 'unit' THEN sc.id END) AS units,
  COUNT(*) FILTER (sc.event = 'skipped') AS skipped, COALESCE(MAX(sc.t_ms) FILTER (sc.event = 'run_end'), {now}) - MIN(sc.since_ms) AS observed_ms, ANY_VALUE(st.stages) AS stages
FROM j LEFT JOIN (SELECT * FROM fx_scope) sc ON sc.media_id = j.media_id LEFT JOIN (
  SELECT media_id, string_agg(stage || ':' || COALESCE(wall_ms, -1) || ':' || outcome, ',' ORDER BY stage) AS stages FROM (
    SELECT s.media_id, s.stage, CASE WHEN f.n IS NULL THEN {now} - s.start_ms ELSE f.wall_ms END AS wall_ms, COALESCE(f.outcome, 'in_progress') AS outcome
    FROM (SELECT media_id, stage, MAX(t_ms) AS start_ms FROM fx_scope WHERE event = 'stage_start' AND stage IS NOT NULL GROUP BY ALL) s
    LEFT JOIN (SELECT media_id, stage, COUNT(*) AS n, arg_max(wall_ms, (t_ms, event_id)) AS wall_ms, arg_max(outcome, (t_ms, event_id)) AS outcome FROM fx_scope WHERE event = 'stage_timing' AND stage IS NOT NULL GROUP BY ALL) f
      USING (media_id, stage)) GROUP BY media_id) st ON st.media_id = j.media_id GROUP BY j.media_id, j.queued_ms, j.updated_ms""".format(now=NOW),
       **dict(RV, fx_scope=SCOPE.replace("900000000", "900000")))
def _(t):
    r = runs(t)
    jobs = r.groupBy("media_id").agg(F.min("t_ms").alias("queued_ms"), F.max("t_ms").alias("updated_ms")).withColumn("status", F.lit("running"))
    shown = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["stage"], F.coalesce(s["wall_ms"], F.lit(-1)).cast("string"), s["outcome"])), ",")
    return ops.snapshot(jobs, r, NOW).drop("active_ms").withColumn("stages", shown)


# Jobs with a preview stop for some and stages from their figures.
JOBS2 = """SELECT job_id, status, queued_ms, updated_ms, media_ms AS duration_ms, CASE WHEN job_id % 6 = 0 THEN media_ms // 3 END AS stop_ms, kb * 1000 AS bytes,
  job_id % 10 = 3 AS expired, events, kb FROM {src}"""
PRIOR_ROWS = ", ".join(f"('{k}', {ops.GROUPS[k]}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in ops.PRIORS.items())
STAGES = """SELECT job_id, stage, CASE (job_id + grp) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'running' ELSE 'todo' END AS state, events % 7 AS done, 10 AS total,
  CASE WHEN (job_id + grp) % 2 = 0 THEN duration_ms // 2 END AS span_ms FROM fx_jobs2, fx_prior WHERE (job_id + grp) % 5 <> 0"""
RANGE = """CASE WHEN stop_ms IS NULL THEN duration_ms WHEN stage = 'separate' THEN LEAST(duration_ms, stop_ms + 60000)
  WHEN stage IN ('translate', 'voice_lines', 'finish', 'export') THEN LEAST(duration_ms, stop_ms + 30000) ELSE duration_ms END"""
GROUP_TOTAL = """SELECT job_id, SUM(v) AS {out} FROM (SELECT job_id, grp, CASE WHEN grp = 5 THEN GREATEST(MAX(CASE WHEN stage = 'separate' THEN x END)
  + MAX(CASE WHEN stage IN ('voice_lines', 'finish') THEN x END), MAX(CASE WHEN stage IN ('translate', 'video') THEN x END)) ELSE MAX(x) END AS v FROM ({src}) GROUP BY job_id, grp) GROUP BY job_id"""
LEFT = GROUP_TOTAL.format(out="left_s", src=f"""SELECT j.job_id, p.stage, p.grp, (lo + hi) / 2 * CASE WHEN state = 'done' THEN COALESCE(GREATEST({RANGE.replace("stage", "p.stage")} - span_ms, 0), 0)
   ELSE ({RANGE.replace("stage", "p.stage")}) * CASE WHEN total > 0 THEN LEAST(GREATEST(1 - done / total, 0), 1) ELSE 1 END END / 1000 AS x
   FROM fx_jobs2 j CROSS JOIN fx_prior p LEFT JOIN fx_stages s ON s.job_id = j.job_id AND s.stage = p.stage""")
JV = dict(fx_jobs2=JOBS2.format(src="fx_jobs"), fx_prior=f"SELECT * FROM (VALUES {PRIOR_ROWS}) v(stage, grp, lo, hi)", fx_stages=STAGES, fx_left=LEFT)


def jobs2(t):
    return t.jobs.selectExpr("job_id", "status", "queued_ms", "updated_ms", "media_ms AS duration_ms", "if(job_id % 6 = 0, media_ms div 3, null) AS stop_ms",
                             "kb * 1000 AS bytes", "job_id % 10 = 3 AS expired", "events", "kb")


def stages(t):
    p = ops._stage_table(t.spark).select("stage", "grp")
    return jobs2(t).crossJoin(F.broadcast(p)).filter("(job_id + grp) % 5 <> 0").selectExpr(
        "job_id", "stage", "case (job_id + grp) % 3 when 0 then 'done' when 1 then 'running' else 'todo' end AS state", "events % 7 AS done", "10 AS total",
        "if((job_id + grp) % 2 = 0, duration_ms div 2, null) AS span_ms")


# Compared in whole milliseconds, with an offset that keeps exact halves of any unit away from the rounding edge.
def ms(col: str) -> str:
    return f"CAST(floor({col} * 1000 + 0.2501234) AS BIGINT)"


@query("time_left", f"SELECT job_id, {ms('left_s')} AS left_ms FROM fx_left", **JV)
def _(t):
    return ops.time_left(jobs2(t), stages(t)).selectExpr("job_id", f"{ms('left_s')} AS left_ms")


EST = f"""SELECT job_id, stage, grp, {{c}} * (({RANGE}) / 1000) AS x FROM fx_jobs2, fx_prior"""


@query("estimate", f"""SELECT l.job_id, {ms('low_s')} AS low_ms, {ms('high_s')} AS high_ms, round_even(LEAST(duration_ms, COALESCE(stop_ms + 30000, duration_ms)) / 1000.0::DOUBLE * 0.18::DOUBLE * 0.16::DOUBLE, 0) + GREATEST(1, ceil(duration_ms / 1000.0::DOUBLE * 2.9::DOUBLE / 8000)) AS calls_low,
  round_even(LEAST(duration_ms, COALESCE(stop_ms + 30000, duration_ms)) / 1000.0::DOUBLE * 0.18::DOUBLE * 0.19::DOUBLE, 0) + GREATEST(1, ceil(duration_ms / 1000.0::DOUBLE * 2.9::DOUBLE / 8000)) AS calls_high
FROM ({GROUP_TOTAL.format(out='low_s', src=EST.format(c='lo'))}) l JOIN ({GROUP_TOTAL.format(out='high_s', src=EST.format(c='hi'))}) h USING (job_id) JOIN fx_jobs2 USING (job_id)""", **JV)
def _(t):
    return ops.estimate(jobs2(t)).selectExpr("job_id", f"{ms('low_s')} AS low_ms", f"{ms('high_s')} AS high_ms", "calls_low", "calls_high")


@query("stage_eta", """SELECT media_id AS job_id, stage, CASE WHEN t1 - t0 >= 30000 AND d1 > d0 THEN GREATEST(total - d1, 0) * (t1 - t0) / 1000.0::DOUBLE / (d1 - d0) ELSE 77.0 END AS eta_s
FROM (SELECT media_id, stage, MIN(t_ms) AS t0, MAX(t_ms) AS t1, arg_min(k, t_ms) AS d0, arg_max(k, t_ms) AS d1, 120 AS total FROM fx_one GROUP BY ALL)""",
       fx_one="SELECT media_id, stage, t_ms, MAX(k) AS k FROM fx_runs WHERE stage IS NOT NULL GROUP BY ALL", **RV)
def _(t):
    p = runs(t).filter("stage is not null").groupBy(F.col("media_id").alias("job_id"), "stage", "t_ms").agg(F.max("k").alias("done")).withColumn("total", F.lit(120))
    return ops.eta(p, p.select("job_id", "stage").distinct().withColumn("left_s", F.lit(77.0)))


@query("queue_report", f"""SELECT job_id, position, {ms('ahead_s')} AS ahead_ms FROM (SELECT job_id, ROW_NUMBER() OVER (ORDER BY queued_ms, job_id) AS position,
  COALESCE(SUM(left_s) OVER (ORDER BY queued_ms, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT COALESCE(SUM(left_s), 0) FROM fx_jobs2 JOIN fx_left USING (job_id) WHERE status = 'running') AS ahead_s
FROM fx_jobs2 JOIN fx_left USING (job_id) WHERE status = 'queued')""", **JV)
def _(t):
    return ops.queue_report(jobs2(t), ops.time_left(jobs2(t), stages(t))).selectExpr("job_id", "position", f"{ms('ahead_s')} AS ahead_ms")


@query("orphan_keys", """SELECT 'd' || doc_id AS key, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    f = t.read("documents").selectExpr("concat('d', cast(doc_id as string)) AS key", "n_chars")
    return ops.orphan_keys(f, t.read("labels").selectExpr("concat('d', cast(doc_id as string)) AS key"))


@query("retention", f"""WITH x AS (SELECT *, NOT expired AND {NOW} - updated_ms > 86400000 AS age, expired OR (status = 'done' AND stop_ms IS NULL) AS capped FROM fx_jobs2 WHERE status <> 'queued'),
r AS (SELECT *, (SELECT SUM(bytes) FROM x WHERE capped) - COALESCE(SUM(CASE WHEN capped AND NOT age THEN bytes ELSE 0 END) OVER (ORDER BY updated_ms, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM x)
SELECT job_id, CASE WHEN age THEN 'age' ELSE 'size' END AS why, bytes FROM r WHERE age OR (capped AND held > 60000 AND (bytes > 0 OR NOT expired))""", **JV)
def _(t):
    return ops.retention(jobs2(t), NOW, days=1, cap=60_000)


@query("clock_gaps", """SELECT media_id, w0 AS at_ms, t_ms AS resumed_ms, (t_ms - w0) - (m - m0) AS slept_ms FROM (
  SELECT *, LAG(t_ms) OVER w AS w0, LAG(m) OVER w AS m0 FROM (SELECT media_id, t_ms, MAX(event_id) * 1000 AS m FROM fx_trace GROUP BY ALL)
  WINDOW w AS (PARTITION BY media_id ORDER BY t_ms)) WHERE (t_ms - w0) - (m - m0) > 60000""")
def _(t):
    k = t.trace.groupBy("media_id", F.col("t_ms").alias("wall_ms")).agg((F.max("event_id") * 1000).alias("mono_ms"))
    return ops.clock_gaps(k)


@query("job_report", """SELECT media_id, COUNT(*) AS lines, COUNT(*) FILTER (id % 4 = 0) AS long, COUNT(*) FILTER (id % 6 = 0) AS unreviewed,
  CAST(SUM(overdraft_ms // 2) AS BIGINT) AS overdraft_ms, CAST(SUM(overdraft_ms - overdraft_ms // 2) AS BIGINT) AS carried_ms FROM fx_plans GROUP BY media_id""")
def _(t):
    return ops.job_report(t.plans.selectExpr("media_id", "filter(array(if(id % 4 = 0, 'long', null), if(id % 6 = 0, 'unreviewed', null)), f -> f is not null) AS flags",
                                             "overdraft_ms div 2 AS own_ms", "overdraft_ms - overdraft_ms div 2 AS carried_ms"))


@query("job_list", f"""SELECT job_id, updated_ms, stage, CASE WHEN state = 'done' AND span_ms < ({RANGE}) - 50 THEN 'todo' ELSE state END AS state
FROM fx_stages JOIN fx_jobs2 USING (job_id)""", **JV)
def _(t):
    return ops.job_list(jobs2(t), stages(t))


@query("manifest", """SELECT p.media_id, lines, lag_p95, rate_p90, overdraft_ms, carried_ms, COALESCE(s.n, 0) AS skipped, COALESCE(k.n, 0) AS speakers, COALESCE(k.ms, 0) AS talk_ms FROM (
  SELECT media_id, COUNT(*) AS lines, quantile_cont(start_ms - src_start_ms, 0.95) AS lag_p95, quantile_cont(rate_pct, 0.9) AS rate_p90, CAST(SUM(overdraft_ms // 2) AS BIGINT) AS overdraft_ms,
    CAST(SUM(overdraft_ms - overdraft_ms // 2) AS BIGINT) AS carried_ms FROM fx_plans WHERE id % 13 <> 0 GROUP BY media_id) p
LEFT JOIN (SELECT media_id, COUNT(*) AS n FROM fx_plans WHERE id % 13 = 0 GROUP BY media_id) s USING (media_id)
LEFT JOIN (SELECT media_id, COUNT(DISTINCT speaker) AS n, CAST(SUM(end_ms - start_ms) AS BIGINT) AS ms FROM fx_ex GROUP BY media_id) k USING (media_id)""")
def _(t):
    p = t.plans.withColumn("own_overdraft_ms", F.expr("overdraft_ms div 2"))
    sp = t.ex.groupBy("media_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"))
    return ops.manifest(p.filter("id % 13 <> 0"), p.filter("id % 13 = 0"), sp)


@query("compare_arms", """WITH r AS (SELECT user_id AS pair, event_type AS arm, MAX(value) AS value FROM events GROUP BY ALL),
f AS (SELECT pair FROM r WHERE value IS NOT NULL GROUP BY pair HAVING COUNT(DISTINCT arm) = (SELECT COUNT(DISTINCT arm) FROM r))
SELECT r.arm, COUNT(*) AS pairs, quantile_cont(r.value, 0.5) AS median, quantile_cont((r.value - b.value) / b.value, 0.5) AS median_change
FROM r JOIN f USING (pair) JOIN (SELECT * FROM r WHERE arm = 'view') b USING (pair) GROUP BY r.arm""")
def _(t):
    r = t.read("events").groupBy(F.col("user_id").alias("pair"), F.col("event_type").alias("arm")).agg(F.max("value").alias("value"))
    return ops.compare_arms(r, "view")


@query("blind_rows", "SELECT COUNT(*) AS n, MIN(k) AS lo, MAX(k) AS hi, COUNT(DISTINCT k) AS d FROM (SELECT ROW_NUMBER() OVER () AS k FROM documents)")
def _(t):
    b = ops.blind_rows(t.read("documents").select("doc_id"), ["doc_id"], 42)
    return b.agg(F.count("*").alias("n"), F.min("blind_id").alias("lo"), F.max("blind_id").alias("hi"), F.count_distinct("blind_id").alias("d"))


@query("ready_prefix", """SELECT media_id, at_ms, MAX(n) AS scenes, MAX(l) AS lines, MAX(end_ms) AS source_until_ms FROM (
  SELECT media_id, end_ms, MAX(ready) OVER w AS at_ms, COUNT(*) OVER w AS n, CAST(SUM(n_words) OVER w AS BIGINT) AS l FROM
   (SELECT media_id, id, n_words, end_ms, CASE WHEN id % 10000 = 30 THEN 9e15::BIGINT ELSE end_ms + (id * 7919) % 40000 END AS ready FROM fx_units)
  WINDOW w AS (PARTITION BY media_id ORDER BY id ROWS UNBOUNDED PRECEDING)) WHERE at_ms < 9e14 GROUP BY media_id, at_ms""")
def _(t):
    s = t.units.selectExpr("media_id", "id AS scene", "n_words AS lines", "end_ms", "if(id % 10000 = 30, null, end_ms + (id * 7919) % 40000) AS ready_ms")
    return ops.ready_prefix(s)
