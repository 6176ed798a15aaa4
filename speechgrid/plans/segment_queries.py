"""Segmentation into sentence units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment as sg
from .interval_queries import moved
from .registry import query

M = ["media_id"]


def words(t):
    return t.words.selectExpr("media_id", "idx", "word", "start_ms", "end_ms", "conf_pct / 100D AS conf")


def chunks(t):
    return sg.chunk_cuts(words(t))


def labelled(t, **kw):
    return sg.label_chunks(words(t), t.ex, chunks(t), overlaps=t.turns, **kw)


@query("label_chunk_words")
def _(t):
    return sg.labelled_words(labelled(t, smooth=False, snap=False)).select("media_id", "idx", "raw")


@query("smooth_labels")
def _(t):
    return sg.labelled_words(labelled(t, snap=False)).select("media_id", "idx", "raw", "smooth", "kept")


@query("snap_boundaries")
def _(t):
    return sg.labelled_words(labelled(t)).select("media_id", "idx", "smooth", "speaker")


def groups(t, until):
    x = sg.explode_units(sg.group_chunks(labelled(t), until))
    return x.select("media_id", "chunk_no", "speaker", "start_ms", "end_ms", "text")


@query("group_words")
def _(t):
    return groups(t, "group")


@query("merge_units")
def _(t):
    return groups(t, "merge")


@query("drop_backchannels")
def _(t):
    return groups(t, "drop")


@query("absorb_and_rebalance")
def _(t):
    return groups(t, "settle")


def segmented(t):
    return sg.segment(words(t), t.ex, overlaps=t.turns)


@query("segment")
def _(t):
    return segmented(t).select("media_id", "id", "speaker", "start_ms", "end_ms", "text", F.size("breaks").alias("breaks"), F.size("anchors").alias("anchors"), "cut_off")


@query("join_seams")
def _(t):
    u = sg.explode_units(sg.group_chunks(labelled(t), "merge"))
    return sg.join_seams(u).select("media_id", "id", "speaker", "start_ms", "end_ms", "text")


SEAMS = """WITH RECURSIVE t AS (SELECT media_id, turn * 10000 + pos // 8 AS id, speaker, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY pos) AS text
  FROM fx_words GROUP BY ALL),
u AS (SELECT *, ROW_NUMBER() OVER w - 1 AS seq, LEAD(speaker) OVER w AS ns, LEAD(start_ms) OVER w AS na FROM t WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, text)),
p AS (SELECT *, ns IS NULL OR ns <> speaker OR na - end_ms > 1000 OR regexp_matches(regexp_replace(text, '["''”’)]+$', ''), '[.?!…।]$') AS part FROM u),
e AS (SELECT media_id, end_ms, MAX(seq) AS seq FROM u GROUP BY ALL),
j AS (SELECT p.*, MIN(CASE WHEN part THEN p.seq END) OVER (PARTITION BY p.media_id ORDER BY p.seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop, e.seq AS far
  FROM p ASOF LEFT JOIN e ON e.media_id = p.media_id AND e.end_ms <= p.start_ms + 20000),
n AS (SELECT *, GREATEST(1, LEAST(stop, COALESCE(far, seq)) - seq + 1) AS n FROM j),
pick AS (SELECT media_id, seq, seq + n AS nxt FROM n WHERE seq = 0 UNION ALL SELECT n.media_id, n.seq, n.seq + n.n FROM pick JOIN n ON n.media_id = pick.media_id AND n.seq = pick.nxt)
SELECT pick.media_id, ROW_NUMBER() OVER (PARTITION BY pick.media_id ORDER BY pick.seq) - 1 AS id, MIN_BY(u.speaker, u.seq) AS speaker, MIN_BY(u.start_ms, u.seq) AS start_ms,
  MAX_BY(u.end_ms, u.seq) AS end_ms, string_agg(u.text, ' ' ORDER BY u.seq) AS text
FROM pick JOIN u ON u.media_id = pick.media_id AND u.seq >= pick.seq AND u.seq < pick.nxt GROUP BY pick.media_id, pick.seq"""


@query("join_seams_of_lines", SEAMS)
def _(t):
    f = sg.word_flags(t.words).withColumn("id", F.expr("turn * 10000 + pos div 8"))
    u = f.groupBy("media_id", "id", "speaker").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("pos", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "ends", "clause", "word"))).alias("words"))
    u = u.withColumn("text", F.expr("array_join(transform(words, w -> w.word), ' ')")).withColumns(sg.unit_pauses()).withColumn("cut_off", F.lit(False))
    return sg.join_seams(u).select("media_id", "id", "speaker", "start_ms", "end_ms", "text")


@query("unit_pauses", """SELECT media_id, id, array_to_string(list(k ORDER BY k) FILTER (gap >= 1000), ',') AS breaks, array_to_string(list(k ORDER BY k) FILTER (gap >= 300 AND m), ',') AS anchors FROM (
  SELECT media_id, turn * 10000 + pos // 8 AS id, pos % 8 AS k, start_ms - LAG(end_ms) OVER (PARTITION BY media_id, turn, pos // 8 ORDER BY pos) AS gap,
   LAG(regexp_matches(regexp_replace(word, '["'')\\]}»”’]+$', ''), '[.?!…।,;:—-]$')
     AND NOT (lower(regexp_replace(word, '["'')\\]}»”’]+$', '')) IN ('mr.', 'mrs.', 'ms.', 'mx.', 'dr.', 'prof.', 'st.', 'vs.', 'jr.', 'sr.', 'e.g.', 'i.e.', 'approx.', 'cf.', 'fig.', 'gen.', 'gov.', 'sen.', 'capt.', 'lt.', 'sgt.')))
     OVER (PARTITION BY media_id, turn, pos // 8 ORDER BY pos) AS m FROM fx_words) GROUP BY media_id, id""")
def _(t):
    f = sg.word_flags(t.words).withColumn("id", F.expr("turn * 10000 + pos div 8"))
    u = f.groupBy("media_id", "id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "ends", "clause"))).alias("words"))
    x = u.withColumns(sg.unit_pauses())
    show = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda k: k.cast("string")), ","))
    return x.select("media_id", "id", show("breaks").alias("breaks"), show("anchors").alias("anchors"))


@query("cut_off_units")
def _(t):
    return segmented(t).groupBy("media_id").agg(F.count("*").alias("units"), F.count_if("cut_off").alias("cut_off"))


SPEECH = """SELECT u.media_id, u.id, CASE WHEN v > 0 THEN v ELSE span END AS speech_ms FROM (SELECT u.media_id, u.id, u.end_ms - u.start_ms AS span,
  LEAST(GREATEST(COALESCE((SELECT CAST(SUM(LEAST(t.end_ms, u.end_ms) - GREATEST(t.start_ms, u.start_ms)) AS BIGINT) FROM fx_part t WHERE t.media_id = u.media_id AND t.speaker = u.speaker
    AND t.start_ms < u.end_ms AND u.start_ms < t.end_ms), 0), w.ms), u.end_ms - u.start_ms) AS v
  FROM fx_units u JOIN (SELECT media_id, turn * 10000 + pos // 8 AS id, CAST(SUM(end_ms - start_ms) AS BIGINT) AS ms FROM fx_words GROUP BY ALL) w ON w.media_id = u.media_id AND w.id = u.id) u"""
PART = "SELECT * REPLACE (start_ms + later AS start_ms, end_ms + later AS end_ms) FROM (SELECT *, CASE WHEN phrase % 3 = 0 THEN 1000000000 ELSE 0 END AS later FROM fx_phrases)"


@query("speech_time", SPEECH, fx_part=PART)
def _(t):
    w = t.words.groupBy("media_id", F.expr("turn * 10000 + pos div 8").alias("id")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("words_ms"))
    return sg.speech_time(t.units.join(w, ["media_id", "id"]), moved(t.phrases, "phrase % 3 = 0")).select("media_id", "id", "speech_ms")


@query("speech_spans", """WITH h AS (SELECT u.media_id, u.id, GREATEST(u.start_ms, t.start_ms) AS start_ms, LEAST(u.end_ms, t.end_ms) AS end_ms FROM fx_units u JOIN fx_part t ON t.media_id = u.media_id
  AND t.speaker = u.speaker AND t.start_ms < u.end_ms AND u.start_ms < t.end_ms)
SELECT * FROM h UNION ALL SELECT media_id, id, start_ms, end_ms FROM fx_units u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.media_id = u.media_id AND h.id = u.id)""", fx_part=PART)
def _(t):
    return sg.speech_spans(t.units, moved(t.phrases, "phrase % 3 = 0"))
