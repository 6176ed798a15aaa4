"""Timing KPIs and frame tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import timing as tm
from .interval_queries import GAPS, islands, moved
from .registry import query

M = ["media_id"]

SLOTS = """SELECT *, LEAD(start_ms) OVER w AS next_start_ms,
  MAX(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end_ms,
  COALESCE(LAG(speaker) OVER w <> speaker AND start_ms < LAG(end_ms) OVER w, false) AS overlaps_prev
FROM fx_lap WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, id)"""
# Lines that overlap now and then: every fifth unit runs 900 ms on.
LAP = "SELECT media_id, id, speaker, start_ms, end_ms + CASE WHEN id % 5 = 0 THEN 900 ELSE 0 END AS end_ms, n_words FROM fx_units"


def lap(t):
    return t.units.selectExpr("media_id", "id", "speaker", "start_ms", "end_ms + if(id % 5 = 0, 900, 0) AS end_ms", "n_words")


@query("line_slots", """SELECT s.media_id, s.id, s.speaker, s.start_ms, s.end_ms, s.n_words, next_start_ms, prev_end_ms, overlaps_prev,
  (SELECT MIN(u.start_ms) FROM fx_lap u WHERE u.media_id = s.media_id AND u.start_ms >= s.end_ms) AS resume_ms FROM fx_slots s""",
       fx_lap=LAP, fx_slots=SLOTS)
def _(t):
    return tm.line_slots(lap(t))


TARGETS = """SELECT media_id, id, end_ms - start_ms + CASE WHEN next_start_ms IS NULL THEN 500
    ELSE LEAST(GREATEST(next_start_ms - end_ms - 150, 0), 500) END AS target_ms,
  CASE WHEN (next_start_ms IS NULL OR next_start_ms - end_ms >= 1000) AND end_ms - start_ms <= 5000 THEN 1000 ELSE 600 END AS lag_limit_ms,
  GREATEST(1.0::DOUBLE, LEAST(1.2::DOUBLE, 7.5::DOUBLE / (4 + id % 5))) AS rate_ceiling FROM fx_slots"""


@query("slot_targets", TARGETS, fx_lap=LAP, fx_slots=SLOTS)
def _(t):
    s = tm.line_slots(lap(t)).withColumn("pace", F.expr("double(4 + id % 5)"))
    return tm.slot_targets(s, "pace", ceiling=7.5).select("media_id", "id", "target_ms", "lag_limit_ms", "rate_ceiling")


BUDGET = """SELECT *, end_ms - start_ms + CASE WHEN next_start_ms IS NULL THEN 800
   ELSE LEAST(GREATEST(GREATEST(next_start_ms - end_ms, 0) - 150, 0), 800) END AS budget_ms,
  (end_ms - start_ms) * (80 + id % 90) // 100 AS dur_ms FROM fx_slots"""


@query("slot_budget", """SELECT media_id, id, budget_ms, budget_ms / 1000 * (4 + id % 5)::DOUBLE * 0.95::DOUBLE AS target_units,
  dur_ms > budget_ms * 1.05 + 1e-6 AS condense FROM fx_budget""", fx_lap=LAP, fx_slots=SLOTS, fx_budget=BUDGET)
def _(t):
    s = tm.line_slots(lap(t)).withColumns({"pace": F.expr("double(4 + id % 5)"),
                                           "dur_ms": F.expr("(end_ms - start_ms) * (80 + id % 90) div 100")})
    return tm.slot_budget(s).select("media_id", "id", "budget_ms", "target_units", "condense")


FIT = """SELECT media_id, id, start_ms, budget_ms, audio_rate, d / audio_rate AS wall_ms FROM (SELECT *, dur_ms::DOUBLE AS d, budget_ms::DOUBLE AS b,
   CASE WHEN dur_ms <= budget_ms THEN 1.0::DOUBLE ELSE LEAST(dur_ms::DOUBLE / budget_ms::DOUBLE, 1.25::DOUBLE) END AS audio_rate FROM fx_budget)"""
FIT2 = """SELECT *, CASE WHEN over > 0 AND GREATEST(budget_ms / wall_ms, 0.75::DOUBLE) < 1 - 1e-6 THEN GREATEST(budget_ms / wall_ms, 0.75::DOUBLE) END AS video_rate
FROM (SELECT *, CASE WHEN wall_ms - budget_ms <= 1e-3 THEN 0.0::DOUBLE ELSE wall_ms - budget_ms END AS over FROM fx_fit)"""
FIT3 = """SELECT *, CASE WHEN GREATEST(over - slow_ms, 0) <= 1e-3 THEN 0.0::DOUBLE ELSE over - slow_ms END AS lft
FROM (SELECT *, COALESCE(budget_ms::DOUBLE / video_rate - budget_ms, 0.0::DOUBLE) AS slow_ms FROM fx_fit2)"""


@query("fit_lines", """SELECT f.media_id, f.id, audio_rate, wall_ms, video_rate, slow_ms, LEAST(lft, 3000.0::DOUBLE) AS freeze_ms, lft > 3000.001 AS condense,
  COALESCE(l.load_ms > 12000, false) AS over_window
FROM fx_fit3 f LEFT JOIN (SELECT media_id, id, CAST(SUM(v) OVER (PARTITION BY media_id ORDER BY t RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS BIGINT) AS load_ms
  FROM (SELECT media_id, id, start_ms + budget_ms AS t, CAST(round(slow_ms + LEAST(lft, 3000.0::DOUBLE)) AS BIGINT) AS v FROM fx_fit3 WHERE lft <= 3000.001)) l
ON l.media_id = f.media_id AND l.id = f.id""", fx_lap=LAP, fx_slots=SLOTS, fx_budget=BUDGET, fx_fit=FIT, fx_fit2=FIT2, fx_fit3=FIT3)
def _(t):
    s = tm.line_slots(lap(t)).withColumn("dur_ms", F.expr("(end_ms - start_ms) * (80 + id % 90) div 100"))
    return tm.fit_lines(s).select("media_id", "id", "audio_rate", "wall_ms", "video_rate", "slow_ms", "freeze_ms", "condense", "over_window")


# Speech: the words of a line. Voiced: the placed line, in two parts; every 13th line is not voiced.
SPEECH = "SELECT media_id, turn * 10000 + pos // 8 AS id, start_ms, end_ms FROM fx_words"
VOICED = """SELECT media_id, id, start_ms, start_ms + (end_ms - start_ms) * 2 // 5 AS end_ms FROM fx_plans WHERE id % 13 <> 0
UNION ALL SELECT media_id, id, start_ms + (end_ms - start_ms) // 2, end_ms FROM fx_plans WHERE id % 13 <> 0"""


def speech(t):
    return t.words.selectExpr("media_id", "turn * 10000 + pos div 8 AS id", "start_ms", "end_ms")


def voiced(t):
    p = t.plans.filter("id % 13 <> 0")
    return (p.selectExpr("media_id", "id", "start_ms", "start_ms + (end_ms - start_ms) * 2 div 5 AS end_ms")
            .unionByName(p.selectExpr("media_id", "id", "start_ms + (end_ms - start_ms) div 2 AS start_ms", "end_ms")))


KEYED = "media_id, id"
LINE = """SELECT u.media_id, u.id, u.start_ms, u.end_ms, s.ms AS speech_ms, v.ms AS voiced_ms, COALESCE(x.ms, 0) AS shared_ms, v.e - s.e AS end_error_ms,
  CASE WHEN s.ms IS NOT NULL AND v.ms IS NOT NULL THEN COALESCE(x.ms, 0) / (s.ms + v.ms - COALESCE(x.ms, 0)) END AS overlap
FROM fx_units u LEFT JOIN (SELECT media_id, id, CAST(SUM(end_ms - start_ms) AS BIGINT) AS ms, MAX(end_ms) AS e FROM fx_su GROUP BY ALL) s USING (media_id, id)
LEFT JOIN (SELECT media_id, id, CAST(SUM(end_ms - start_ms) AS BIGINT) AS ms, MAX(end_ms) AS e FROM fx_vu GROUP BY ALL) v USING (media_id, id)
LEFT JOIN (SELECT media_id, id, CAST(SUM(LEAST(a.end_ms, b.end_ms) - GREATEST(a.start_ms, b.start_ms)) AS BIGINT) AS ms FROM fx_su a JOIN fx_vu b
  USING (media_id, id) WHERE a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY ALL) x USING (media_id, id)"""
LV = dict(fx_speech=SPEECH, fx_voiced=VOICED, fx_su=islands("fx_speech", KEYED), fx_vu=islands("fx_voiced", KEYED), fx_line=LINE)


@query("line_metrics", "SELECT media_id, id, speech_ms, voiced_ms, shared_ms, end_error_ms, overlap FROM fx_line", **LV)
def _(t):
    m = tm.line_metrics(t.units.select("media_id", "id"), speech(t), voiced(t))
    return m.select("media_id", "id", "speech_ms", "voiced_ms", "shared_ms", "end_error_ms", "overlap")


SPEECH_METRICS = """SELECT l.media_id, COUNT(end_error_ms) AS speech_lines, quantile_cont(end_error_ms, 0.1) AS end_error_p10,
  quantile_cont(end_error_ms, 0.5) AS end_error_p50, quantile_cont(end_error_ms, 0.9) AS end_error_p90,
  AVG(CASE WHEN end_error_ms < -200 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (end_error_ms IS NOT NULL) AS end_early_share,
  COUNT(end_error_ms) FILTER (end_ms - start_ms > 4000) AS long_lines,
  quantile_cont(end_error_ms, 0.5) FILTER (end_ms - start_ms > 4000) AS long_end_error_p50, AVG(overlap) AS overlap_mean,
  ANY_VALUE((h.ms - COALESCE(x.ms, 0)) * 60.0::DOUBLE / h.ms) AS silent_s_per_min
FROM fx_line l JOIN (SELECT media_id, CAST(SUM(end_ms - start_ms) AS BIGINT) AS ms FROM fx_su2 GROUP BY ALL) h ON h.media_id = l.media_id
LEFT JOIN (SELECT a.media_id, CAST(SUM(LEAST(a.end_ms, b.end_ms) - GREATEST(a.start_ms, b.start_ms)) AS BIGINT) AS ms FROM fx_su2 a JOIN fx_vu2 b
  ON a.media_id = b.media_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY ALL) x ON x.media_id = l.media_id GROUP BY l.media_id"""
LV2 = dict(LV, fx_su2=islands("fx_speech"), fx_vu2=islands("fx_voiced"))


@query("speech_metrics", SPEECH_METRICS, **LV2)
def _(t):
    return tm.speech_metrics(t.units, speech(t), voiced(t), long_ms=4_000, early_ms=200)


@query("guards", """SELECT media_id, guard, value, lim AS "limit", CASE WHEN guard LIKE '%end_error%' THEN abs(value) ELSE value END <= lim + 1e-9 AS ok FROM (
  SELECT media_id, unnest(['lag_p95', 'rate_p90', 'freeze_s_per_10min', 'rate_step_p90', 'silent_s_per_min', 'end_error_p50', 'end_early_1s_share', 'long_end_error_p50']) AS guard,
    unnest([NULL, NULL, NULL, 0.2::DOUBLE, silent_s_per_min, end_error_p50 / 1000, end_early_share, long_end_error_p50 / 1000]) AS value,
    unnest([0.3, 1.1, 1.0, NULL, 3.0, 0.3, 0.05, 0.1]::DOUBLE[]) AS lim FROM fx_sm)""", fx_sm=SPEECH_METRICS, **LV2)
def _(t):
    m = tm.speech_metrics(t.units, speech(t), voiced(t), long_ms=4_000, early_ms=200)
    d = F.lit(None).cast("double")
    s = m.select("media_id", d.alias("lag_p95"), d.alias("rate_p90"), d.alias("freeze_s_per_10min"), F.lit(0.2).alias("rate_step_p90"),
                 "silent_s_per_min", (F.col("end_error_p50") / 1000).alias("end_error_p50"), F.col("end_early_share").alias("end_early_1s_share"),
                 (F.col("long_end_error_p50") / 1000).alias("long_end_error_p50"))
    base = m.select("media_id", d.alias("rate_step_p90"), F.lit(0.1).alias("end_early_1s_share"), F.lit(-0.2).alias("long_end_error_p50"))
    return tm.guards(s, base)


EVENTS = """SELECT media_id, id, id AS event_id, start_ms AS t_ms, CASE WHEN id % 13 = 0 THEN 'skipped' ELSE 'unit' END AS event, NULL AS outcome, speaker, src_start_ms AS start_ms,
  src_end_ms AS end_ms, start_ms - src_start_ms AS lag_ms, rate_pct, 'whole' AS said, freeze_ms FROM fx_plans
UNION ALL SELECT media_id, id, id + 1, end_ms + 9000, 'rephrase', CASE WHEN id % 3 = 0 THEN 'replaced' ELSE 'kept' END, speaker, NULL, NULL, NULL, NULL,
  CASE WHEN id % 2 = 0 THEN 'pieces' ELSE 'joined' END, CASE WHEN id % 4 = 0 THEN 0 END FROM fx_plans WHERE id % 5 = 0"""


def unit_events(t):
    p = t.plans
    a = p.selectExpr("media_id", "id", "id AS event_id", "start_ms AS t_ms", "if(id % 13 = 0, 'skipped', 'unit') AS event", "cast(null as string) AS outcome", "speaker",
                     "src_start_ms AS start_ms", "src_end_ms AS end_ms", "start_ms - src_start_ms AS lag_ms", "rate_pct", "'whole' AS said", "freeze_ms")
    b = p.filter("id % 5 = 0").selectExpr(
        "media_id", "id", "id + 1 AS event_id", "end_ms + 9000 AS t_ms", "'rephrase' AS event", "if(id % 3 = 0, 'replaced', 'kept') AS outcome", "speaker",
        "cast(null as bigint) AS start_ms", "cast(null as bigint) AS end_ms", "cast(null as bigint) AS lag_ms", "cast(null as bigint) AS rate_pct",
        "if(id % 2 = 0, 'pieces', 'joined') AS said", "if(id % 4 = 0, 0L, null) AS freeze_ms")
    return a.unionByName(b)


@query("timing_report", """WITH u AS (SELECT e.media_id, e.id, e.speaker, e.start_ms, e.end_ms, e.lag_ms, e.rate_pct, COALESCE(r.said, e.said) AS said,
   COALESCE(r.freeze_ms, e.freeze_ms) AS freeze_ms FROM fx_ev e LEFT JOIN fx_ev r ON r.media_id = e.media_id AND r.id = e.id AND r.event = 'rephrase'
   AND r.outcome = 'replaced' WHERE e.event = 'unit'),
s AS (SELECT *, ABS(rate_pct - LAG(rate_pct) OVER (PARTITION BY media_id, speaker ORDER BY start_ms, id)) AS step FROM u),
k AS (SELECT media_id, COUNT(*) AS skipped, MIN(start_ms) AS a, MAX(end_ms) AS b FROM fx_ev WHERE event = 'skipped' GROUP BY media_id),
g AS (SELECT media_id, COUNT(*) AS lines, quantile_cont(lag_ms, 0.95) AS lag_p95, quantile_cont(rate_pct, 0.9) AS rate_p90, quantile_cont(step, 0.9) AS rate_step_p90,
  SUM(freeze_ms) AS f, COUNT(*) FILTER (said = 'whole') AS said_whole, COUNT(*) FILTER (said = 'pieces') AS said_pieces, COUNT(*) FILTER (said = 'joined') AS said_joined,
  MIN(start_ms) AS a, MAX(end_ms) AS b FROM s GROUP BY media_id)
SELECT COALESCE(g.media_id, k.media_id) AS media_id, COALESCE(lines, 0) AS lines, COALESCE(skipped, 0) AS skipped, lag_p95, rate_p90, rate_step_p90,
  COALESCE(said_whole, 0) AS said_whole, COALESCE(said_pieces, 0) AS said_pieces, COALESCE(said_joined, 0) AS said_joined, 0 AS said_anchored,
  f * 600.0::DOUBLE / (GREATEST(COALESCE(g.b, k.b), COALESCE(k.b, g.b)) - LEAST(COALESCE(g.a, k.a), COALESCE(k.a, g.a))) AS freeze_s_per_10min
FROM g FULL JOIN k ON g.media_id = k.media_id""", fx_ev=EVENTS)
def _(t):
    return tm.timing_report(unit_events(t))


@query("plan_stats", """WITH p AS (SELECT *, start_ms - src_start_ms AS lag, LAG(overdraft_ms) OVER w AS po,
   ABS(rate_pct - LAG(rate_pct) OVER (PARTITION BY media_id, speaker ORDER BY src_start_ms, id)) AS step,
   GREATEST(LEAST(end_ms, src_end_ms) - GREATEST(start_ms, src_start_ms), 0)::DOUBLE / (GREATEST(end_ms, src_end_ms) - LEAST(start_ms, src_start_ms)) AS iou
   FROM fx_plans WINDOW w AS (PARTITION BY media_id ORDER BY src_start_ms, id))
SELECT media_id, COUNT(*) AS lines, MAX(src_end_ms) - MIN(src_start_ms) AS span_ms, quantile_cont(lag, 0.5) AS lag_p50, quantile_cont(lag, 0.95) AS lag_p95,
  MAX(lag) AS lag_max, MIN(lag) AS lag_min, COALESCE(MAX(lag) FILTER (COALESCE(po, 0) <= 0), 0) AS lag_max_unflagged,
  AVG(CASE WHEN lag > 300 THEN 1.0::DOUBLE ELSE 0.0 END) AS late_share, AVG(rate_pct) AS rate_mean, quantile_cont(rate_pct, 0.5) AS rate_p50,
  quantile_cont(rate_pct, 0.9) AS rate_p90, MAX(rate_pct) AS rate_max, AVG(CASE WHEN rate_pct >= 120 THEN 1.0::DOUBLE ELSE 0.0 END) AS at_cap_share,
  COALESCE(quantile_cont(step, 0.9), 0.0) AS rate_step_p90, COALESCE(AVG(CASE WHEN step <= 10 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (step IS NOT NULL), 1.0) AS rate_step_ok_share,
  COUNT(*) FILTER (freeze_ms > 0) AS freezes, CAST(SUM(freeze_ms) AS BIGINT) AS freeze_ms, CAST(SUM(overdraft_ms // 2) AS BIGINT) AS overdraft_ms,
  COUNT(*) FILTER (overdraft_ms // 2 > 0) AS overdraft_lines, CAST(SUM(overdraft_ms - overdraft_ms // 2) AS BIGINT) AS carried_ms, AVG(iou) AS iou_mean,
  0 AS said_pieces, 0 AS said_joined, 0 AS said_anchored FROM p GROUP BY media_id""")
def _(t):
    return tm.plan_stats(t.plans.withColumn("own_overdraft_ms", F.expr("overdraft_ms div 2")), late_ms=300)


@query("dub_metrics", """SELECT media_id, COUNT(*) AS lines, """ + ", ".join(
    f"AVG(CASE WHEN {c} = '{k}' THEN 1.0::DOUBLE ELSE 0.0 END) AS {p}{k}" for c, p in (("cls", "share_"), ("cf", "first_"))
    for k in ("C", "m", "P", "E", "other_tier", "unreviewed")) + """,
  COUNT(*) FILTER (id % 9 = 0) AS retranslations_kept, SUM(played)::DOUBLE / SUM(sp) AS speech_fill, quantile_cont(played::DOUBLE / sp, 0.5) AS speech_fill_median,
  AVG(CASE WHEN take / sp BETWEEN 0.9 AND 1.2 THEN 1.0::DOUBLE ELSE 0.0 END) AS rate_in_band_share
FROM (SELECT media_id, id, (['C', 'C', 'm', 'P', 'E', 'other_tier', 'unreviewed'])[id % 7 + 1] AS cls, (['C', 'm', 'P', 'E'])[id % 4 + 1] AS cf,
  src_end_ms - src_start_ms AS sp, end_ms - start_ms AS played, ((src_end_ms - src_start_ms) * (70 + id % 60) // 100)::DOUBLE AS take FROM fx_plans)
GROUP BY media_id""")
def _(t):
    x = t.plans.selectExpr("media_id", "array('C', 'C', 'm', 'P', 'E', 'other_tier', 'unreviewed')[int(id % 7)] AS cls", "array('C', 'm', 'P', 'E')[int(id % 4)] AS cls_first",
                           "if(id % 9 = 0, 'validators', 'review') AS verdict_by", "src_end_ms - src_start_ms AS speech_ms", "end_ms - start_ms AS played_ms",
                           "(src_end_ms - src_start_ms) * (70 + id % 60) div 100 AS take_ms")
    return tm.dub_metrics(x)


TAKES = "SELECT media_id, speaker AS voice, id AS at, n_words * 2 AS units, (end_ms - start_ms) / 1000.0::DOUBLE AS seconds FROM fx_units"


def takes(t):
    return t.units.selectExpr("media_id", "speaker AS voice", "id AS at", "n_words * 2 AS units", "(end_ms - start_ms) / 1000D AS seconds")


CAL = """SELECT media_id, voice, 1 / LEAST(GREATEST(CASE WHEN ov BETWEEN 0 AND 1 THEN inv ELSE (sus - LEAST(GREATEST(ov, 0), 1) * su) / suu END, 1 / 20.0::DOUBLE), 1 / 1.5::DOUBLE) AS rate,
  LEAST(GREATEST(ov, 0), 1) AS overhead, n FROM (SELECT media_id, voice, COUNT(*) AS n, regr_slope(seconds, units) AS inv, regr_intercept(seconds, units) AS ov, SUM(units)::DOUBLE AS su,
  SUM(units * units)::DOUBLE AS suu, SUM(units * seconds) AS sus FROM fx_takes GROUP BY ALL HAVING MIN(units) < MAX(units))"""


PACE_STEP = """WITH RECURSIVE o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id, voice ORDER BY "at") AS k FROM fx_takes),
m AS (SELECT media_id, voice, 0::BIGINT AS k, 1 / 6.1::DOUBLE AS inv, 0.15::DOUBLE AS ov, 0.5::DOUBLE AS p0, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.01::DOUBLE AS p3
      FROM fx_takes GROUP BY media_id, voice
  UNION ALL
  SELECT media_id, voice, k, LEAST(GREATEST(inv + x1 / den * err, 1 / 20.0::DOUBLE), 1 / 1.5::DOUBLE), LEAST(GREATEST(ov + x0 / den * err, 0), 1),
    (p0 - x0 / den * x0) / 0.98::DOUBLE, (p1 - x0 / den * x1) / 0.98::DOUBLE, (p2 - x1 / den * x0) / 0.98::DOUBLE, (p3 - x1 / den * x1) / 0.98::DOUBLE
  FROM (SELECT *, 0.98::DOUBLE / (CASE WHEN abs(err) <= 0.35 THEN 1 ELSE 0.35::DOUBLE / abs(err) END) + x0 + units * x1 AS den FROM (
    SELECT m.media_id, m.voice, o.k, inv, ov, p0, p1, p2, p3, units, seconds - (ov + units * inv) AS err, p0 + p1 * units AS x0, p2 + p3 * units AS x1
    FROM m JOIN o ON o.media_id = m.media_id AND o.voice = m.voice AND o.k = m.k + 1)))
SELECT media_id, voice, 1 / GREATEST(arg_max(inv, k), 1e-3) AS rate, arg_max(ov, k) AS overhead, MAX(k) AS n FROM m GROUP BY media_id, voice"""


@query("online_pace", PACE_STEP, fx_takes=TAKES)
def _(t):
    return tm.online_pace(takes(t), ["media_id", "voice"])


# Voices with one length fall back to the paces read in order.
CAL_ALL = f"""SELECT media_id, voice, rate, overhead, n FROM ({CAL}) UNION ALL
SELECT media_id, voice, rate, overhead, n FROM ({PACE_STEP}) SEMI JOIN (SELECT media_id, voice FROM fx_takes GROUP BY ALL HAVING MIN(units) = MAX(units)) USING (media_id, voice)"""


@query("calibrate_pace", CAL_ALL, fx_takes=TAKES)
def _(t):
    return tm.calibrate_pace(takes(t), ["media_id", "voice"])


@query("estimate_duration", """SELECT t.media_id, t.at, t.voice, GREATEST(COALESCE(overhead, 0.15) + units / COALESCE(rate, 6.1), 0.05) AS est_s
FROM fx_takes t LEFT JOIN fx_cal c ON c.media_id = t.media_id AND c.voice = t.voice""", fx_takes=TAKES, fx_cal=CAL_ALL)
def _(t):
    x = takes(t)
    return tm.estimate_duration(x, tm.calibrate_pace(x, ["media_id", "voice"]), ["media_id", "voice"]).select("media_id", "at", "voice", "est_s")


@query("wall_time", """SELECT w.media_id, w.idx, w.start_ms + COALESCE((SELECT SUM(CASE WHEN rate IS NULL THEN CASE WHEN w.start_ms >= at_ms THEN added_ms ELSE 0 END
   WHEN w.start_ms > at_ms THEN LEAST(w.start_ms - at_ms, span_ms) * (1 / rate - 1) ELSE 0 END)
   FROM fx_edits e WHERE e.media_id = w.media_id), 0.0)::DOUBLE AS wall_ms FROM fx_words w""",
       fx_edits="""SELECT media_id, src_start_ms AS at_ms, src_end_ms - src_start_ms AS span_ms, 0.8::DOUBLE AS rate, 0 AS added_ms FROM fx_plans WHERE id % 3 = 0
       UNION ALL SELECT media_id, src_end_ms, 0, NULL, freeze_ms FROM fx_plans WHERE freeze_ms > 0""")
def _(t):
    p = t.plans
    e = p.filter("id % 3 = 0").selectExpr("media_id", "src_start_ms AS at_ms", "src_end_ms - src_start_ms AS span_ms", "0.8D AS rate", "0L AS added_ms").unionByName(
        p.filter("freeze_ms > 0").selectExpr("media_id", "src_end_ms AS at_ms", "0L AS span_ms", "cast(null as double) AS rate", "freeze_ms AS added_ms"))
    return tm.wall_time(t.words.select("media_id", "idx", "start_ms"), e, "start_ms", ["idx"]).select("media_id", "idx", "wall_ms")


@query("scale_sweep", """SELECT media_id, scale, COUNT(*) AS lines, AVG(CASE WHEN d <= budget_ms THEN 1.0::DOUBLE ELSE 0.0 END) AS fits_share,
  AVG(CASE WHEN d > budget_ms * 1.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.0 END) AS condense_share, SUM(round(GREATEST(d / rate - budget_ms, 0))) AS overflow_ms,
  quantile_cont(rate, 0.5) AS rate_p50, quantile_cont(rate, 0.9) AS rate_p90
FROM (SELECT *, CASE WHEN d <= budget_ms THEN 1.0::DOUBLE ELSE LEAST(d / budget_ms, 1.25::DOUBLE) END AS rate FROM (
  SELECT *, dur_ms * scale AS d FROM fx_budget, (SELECT unnest([0.8, 1.0, 1.3]::DOUBLE[]) AS scale))) GROUP BY media_id, scale""",
       fx_lap=LAP, fx_slots=SLOTS, fx_budget=BUDGET)
def _(t):
    x = lap(t).withColumn("dur_ms", F.expr("(end_ms - start_ms) * (80 + id % 90) div 100"))
    return tm.scale_sweep(x, [0.8, 1.0, 1.3])


@query("anchor_errors", """SELECT p.media_id, p.id, 1 AS part, MIN(v.start_ms) - ANY_VALUE(src_start_ms + (src_end_ms - src_start_ms) // 2) AS error_ms
FROM fx_plans p JOIN fx_voiced v ON v.media_id = p.media_id AND v.id = p.id AND v.start_ms >= p.start_ms + (p.end_ms - p.start_ms) // 3 - 1
GROUP BY p.media_id, p.id""", fx_voiced=VOICED)
def _(t):
    parts = t.plans.selectExpr("media_id", "id", "explode(array(0, 1)) AS part", "start_ms + (end_ms - start_ms) div 3 AS start_ms",
                               "src_start_ms + (src_end_ms - src_start_ms) div 2 AS src_ms")
    return tm.anchor_errors(parts, voiced(t))


@query("match_breaks", """SELECT media_id, id, arg_min([i, j], (abs(1.0::DOUBLE / 4 - b[i + 1]) + abs(3.0::DOUBLE / 4 - b[j + 1]), i, j)) AS picked FROM (
  SELECT media_id, id, [x / 100.0::DOUBLE, (x + 10) / 100.0::DOUBLE, (x + 25) / 100.0::DOUBLE, (x + 60) / 100.0::DOUBLE] AS b FROM (SELECT media_id, id, conf_sum % 30 AS x FROM fx_units)),
  (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE i < j GROUP BY media_id, id""")
def _(t):
    x = t.units.selectExpr("media_id", "id", "array(1.0D, 2.0D, 1.0D) AS durations",
                           "array(conf_sum % 30 / 100.0D, (conf_sum % 30 + 10) / 100.0D, (conf_sum % 30 + 25) / 100.0D, (conf_sum % 30 + 60) / 100.0D) AS break_share")
    return tm.match_breaks(x).select("media_id", "id", "picked")


# A take is one line; its frames are the 10 ms steps, loud where a word sounds.
TAKE_FRAMES = """SELECT w.media_id, w.turn * 10000 + w.pos // 8 AS take, unnest(range(w.start_ms // 10, w.end_ms // 10)) - s.a AS frame_no, 0.5::DOUBLE AS value FROM fx_words w
JOIN fx_take s ON s.media_id = w.media_id AND s.turn = w.turn * 10000 + w.pos // 8"""
TAKE = "SELECT media_id, turn * 10000 + pos // 8 AS turn, MIN(start_ms) // 10 - 7 AS a, MAX(end_ms) // 10 + 30 AS b FROM fx_words GROUP BY ALL"
FULL_FRAMES = """SELECT s.media_id, s.turn AS take, f.frame_no, COALESCE(MAX(v.value), 0.0) AS value FROM fx_take s, LATERAL (SELECT unnest(range(s.b - s.a)) AS frame_no) f
LEFT JOIN fx_loud v ON v.media_id = s.media_id AND v.take = s.turn AND v.frame_no = f.frame_no GROUP BY ALL"""
PAUSES = """SELECT media_id, take, MIN(frame_no) * 10 AS start_ms, (MAX(frame_no) + 1) * 10 AS end_ms FROM (
  SELECT f.*, m.hi, frame_no - ROW_NUMBER() OVER (PARTITION BY f.media_id, f.take ORDER BY frame_no) AS g FROM fx_frame10 f
  JOIN (SELECT media_id, take, quantile_cont(value, 0.95) AS p, MAX(frame_no) AS hi FROM fx_frame10 GROUP BY ALL) m ON m.media_id = f.media_id AND m.take = f.take
  WHERE p <= 1e-6 OR value < p * 0.01) GROUP BY media_id, take, g
HAVING (MAX(frame_no) - MIN(frame_no) + 1) * 10 >= 150 OR MIN(frame_no) = 0 OR MAX(frame_no) = ANY_VALUE(hi)"""
TF = dict(fx_take=TAKE, fx_loud=TAKE_FRAMES, fx_frame10=FULL_FRAMES, fx_pause=PAUSES)


def take_frames(t):
    """Each word brings the silence before it and its own loud frames; the last one the silence after it. Equal frames in a row are
    one row of ``n``."""
    w = Window.partitionBy("media_id", "take").orderBy("pos")  # the eight words of one line
    x = t.words.select("media_id", F.expr("turn * 10000 + pos div 8").alias("take"), "pos", F.expr("start_ms div 10").alias("s"), F.expr("end_ms div 10").alias("e"))
    x = x.withColumns({"a": F.min("s").over(w) - 7, "pe": F.lag("e").over(w), "more": F.lead("pos").over(w)})
    runs = """inline(array(struct(coalesce(pe, a) - a as frame_no, s - coalesce(pe, a) as n, 0.0D as value), struct(s - a as frame_no, e - s as n, 0.5D as value),
      struct(e - a as frame_no, if(more is null, 30L, 0L) as n, 0.0D as value)))"""
    return x.selectExpr("media_id", "take", runs).filter("n > 0")


def totals(frames):
    return frames.groupBy("media_id", "take").agg((F.max(F.col("frame_no") + F.col("n")) * 10).alias("total_ms"))


@query("take_pauses", "SELECT * FROM fx_pause", **TF)
def _(t):
    return fr.pauses(take_frames(t))


@query("internal_pauses", """SELECT p.* FROM fx_pause p JOIN fx_take s ON s.media_id = p.media_id AND s.turn = p.take
WHERE start_ms * 2 > 10 AND ((b - a) * 10 - end_ms) * 2 > 10""", **TF)
def _(t):
    f = take_frames(t)
    return fr.internal(fr.pauses(f), totals(f))


@query("voiced_spans", """SELECT media_id, take, s AS start_ms, e AS end_ms FROM (
  SELECT media_id, take, end_ms AS s, LEAD(start_ms) OVER (PARTITION BY media_id, take ORDER BY start_ms) AS e FROM fx_pause) WHERE e > s""", **TF)
def _(t):
    f = take_frames(t)
    return fr.voiced(fr.pauses(f), totals(f))


@query("squeeze")
def _(t):
    p = (t.words.groupBy("media_id", "turn").agg(F.expr("transform(array_sort(collect_list(pos)), p -> 150L + p * 37 % 700)").alias("pauses"),
                                                                       F.max("pos").alias("n")))
    x = p.selectExpr("media_id", "turn", "pauses", "aggregate(pauses, 4000L, (a, d) -> a + d) AS total_ms", "1.0D + (turn % 5 + 1) * 0.06D AS rate")
    return fr.squeeze(x)


@query("take_failures", """SELECT media_id, id, CASE WHEN id % 11 = 0 THEN 'audio_empty' WHEN id % 7 = 0 THEN 'audio_nonfinite' WHEN n_words < 3 THEN 'audio_silent' WHEN id % 5 = 0 THEN 'cap'
  WHEN (end_ms - start_ms) < 0.6 * n_words * 400 THEN 'short' END AS failure FROM fx_units""")
def _(t):
    u = t.units
    k = u.selectExpr("media_id", "id", "double(end_ms - start_ms) AS seconds", "id % 5 = 0 AS capped", "double(n_words * 400) AS estimate")
    s = (t.words.selectExpr("media_id", "turn * 10000 + pos div 8 AS id", "pos").filter("id % 11 <> 0")
         .join(u.select("media_id", "id", "n_words"), ["media_id", "id"])
         .selectExpr("media_id", "id", "case when id % 7 = 0 and pos % 8 = 0 then double('NaN') when n_words < 3 then 1e-7D else 0.25D end AS value"))
    return fr.take_failures(k, s, ["media_id", "id"]).select("media_id", "id", "failure")


@query("pick_take", """SELECT media_id, id, arg_min(take, (CASE f WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END, abs(ln((n_words * (300 + k * 70)) / 1000.0::DOUBLE / tgt)), take)) AS take
FROM (SELECT media_id, id, n_words, k, 't' || k AS take, (id + k) % 3 AS f, GREATEST((end_ms - start_ms) / 1000.0::DOUBLE, 1e-3) AS tgt FROM fx_units, (SELECT unnest(range(3)) AS k))
GROUP BY media_id, id""")
def _(t):
    x = t.units.selectExpr("media_id", "id", "n_words", "(end_ms - start_ms) / 1000.0D AS target_s", "explode(array(0, 1, 2)) AS k").selectExpr(
        "media_id", "id", "concat('t', cast(k as string)) AS take", "element_at(array(null, 'cap', 'short'), int((id + k) % 3) + 1) AS failure",
        "n_words * (300 + k * 70) / 1000.0D AS seconds", "target_s")
    return fr.pick_take(x)


DUCK = dict(fx_two="SELECT media_id, start_ms, end_ms FROM fx_dl UNION ALL SELECT media_id, start_ms, end_ms FROM fx_ex",
            fx_dl="SELECT media_id, start_ms + later AS start_ms, end_ms + later AS end_ms FROM (SELECT *, CASE WHEN (id // 10000) % 3 = 1 THEN 1000000000 ELSE 0 END AS later FROM fx_plans)", fx_duck=islands("fx_two", rule="start_ms < top + 500"),
            fx_sp=islands("fx_ex", rule="start_ms < top + 500"), fx_near0="SELECT media_id, start_ms - 1000 AS start_ms, end_ms + 1000 AS end_ms FROM fx_dl",
            fx_near=islands("fx_near0"), fx_bare0=GAPS.format(ident="", a="fx_sp", u="fx_near", least=1499),
            fx_bare="SELECT * FROM fx_bare0 UNION ALL SELECT * FROM fx_sp s WHERE NOT EXISTS (SELECT 1 FROM fx_near n WHERE n.media_id = s.media_id) AND end_ms - start_ms > 1499",
            fx_spans="SELECT *, 'duck' AS kind FROM fx_duck UNION ALL SELECT *, 'bare' FROM fx_bare")


def ducks(t):
    return fr.duck_spans(moved(t.plans, "(id div 10000) % 3 = 1"), t.ex)


@query("duck_spans", "SELECT * FROM fx_spans", **DUCK)
def _(t):
    return ducks(t)


@query("gain_envelope", """WITH f AS (SELECT media_id, unnest(range(0, (duration_ms - 1) // 100 + 1)) AS frame_no FROM fx_durations),
r AS (SELECT f.media_id, f.frame_no, kind, MAX(CASE WHEN frame_no * 100 < start_ms THEN 0.5 - 0.5 * cos(pi() * (frame_no * 100 - start_ms + 150) / 150)
   WHEN frame_no * 100 < end_ms THEN 1.0 ELSE 0.5 + 0.5 * cos(pi() * (frame_no * 100 - end_ms) / 400) END) AS r
  FROM (SELECT media_id, kind, start_ms, end_ms, unnest(range(GREATEST(CAST(ceil((start_ms - 150) / 100.0) AS BIGINT), 0), CAST(ceil((end_ms + 400) / 100.0) AS BIGINT))) AS frame_no FROM fx_spans) f GROUP BY ALL)
SELECT f.media_id, f.frame_no, pow(10.0::DOUBLE, (COALESCE(d.r, 0) * -6 + COALESCE(b.r, 0) * -6) / 20) AS gain FROM f
LEFT JOIN (SELECT * FROM r WHERE kind = 'duck') d ON d.media_id = f.media_id AND d.frame_no = f.frame_no
LEFT JOIN (SELECT * FROM r WHERE kind = 'bare') b ON b.media_id = f.media_id AND b.frame_no = f.frame_no""", **DUCK)
def _(t):
    return fr.gain_envelope(ducks(t), t.durations)


@query("bed_gain", """SELECT l.media_id, LEAST(GREATEST(10 * log10(SUM(pow(10.0::DOUBLE, (length(speaker) - 6) / 10.0::DOUBLE) * conf_sum) / SUM(n_words) / ANY_VALUE(v)), -12), 12) AS gain_db
FROM fx_units l JOIN (SELECT media_id, AVG(value) AS v FROM fx_frames GROUP BY media_id) f ON f.media_id = l.media_id GROUP BY l.media_id""")
def _(t):
    ln = t.units.selectExpr("media_id", "speaker", "double(conf_sum) AS energy", "n_words AS samples")
    g = t.units.select("media_id", "speaker").distinct().withColumn("gain_db", F.expr("double(length(speaker) - 6)"))
    return fr.bed_gain(ln, g, t.frames.groupBy("media_id").agg(F.avg("value").alias("mean")))


@query("speaker_gains", """SELECT media_id, speaker, loudness, CASE WHEN loudness <= -69 THEN 0.0::DOUBLE ELSE LEAST(GREATEST(-20 - loudness, -6), 6) END AS gain_db
FROM (SELECT media_id, speaker, -10.0::DOUBLE - (SUM(conf_sum) % 70) AS loudness FROM fx_units GROUP BY ALL)""")
def _(t):
    x = t.units.groupBy("media_id", "speaker").agg(F.expr("-10.0D - sum(conf_sum) % 70").alias("loudness"))
    return fr.speaker_gains(x)
