"""Interval algebra over the derived turns, words and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .registry import query

M = ["media_id"]

ISLANDS = """SELECT {by}, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms FROM (
  SELECT *, SUM(CASE WHEN top IS NULL OR NOT ({rule}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY {by} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, MAX(end_ms) OVER (PARTITION BY {by} ORDER BY start_ms, end_ms
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {src}))
GROUP BY {by}, island"""


def islands(src: str, by: str = "media_id", rule: str = "start_ms <= top") -> str:
    return ISLANDS.format(src=src, by=by, rule=rule)


@query("union_touching", islands("fx_turns"))
def _(t):
    return iv.interval_union(t.turns, M)


@query("union_bridged", islands("fx_words", rule="start_ms < top + 300"))
def _(t):
    return iv.interval_union(t.words, M, touch=False, bridge_ms=300)


@query("union_apart", islands("fx_touch", rule="start_ms < top"),
       fx_touch="""SELECT media_id, start_ms, end_ms FROM fx_ex
                   UNION ALL SELECT media_id, end_ms, end_ms + 700 FROM fx_ex""")
def _(t):
    tail = t.ex.select("media_id", F.col("end_ms").alias("start_ms"), (F.col("end_ms") + 700).alias("end_ms"))
    return iv.interval_union(t.ex.select("media_id", "start_ms", "end_ms").union(tail), M, touch=False)


@query("union_coverage", islands("fx_words", rule="start_ms <= top + 1"))
def _(t):
    return iv.coverage(t.words)


@query("join_speaker_turns", islands("fx_turns", by="media_id, speaker", rule="start_ms <= top + 1"))
def _(t):
    return iv.join_turns(t.turns)


@query("union_length", "SELECT media_id, CAST(SUM(end_ms - start_ms) AS BIGINT) AS length_ms FROM fx_u GROUP BY media_id",
       fx_u=islands("fx_turns"))
def _(t):
    return iv.interval_length(t.turns, M)


@query("overlap_rows", """SELECT w.media_id, w.idx, w.word, t.speaker AS b_speaker, GREATEST(w.start_ms, t.start_ms) AS start_ms,
  LEAST(w.end_ms, t.end_ms) AS end_ms, LEAST(w.end_ms, t.end_ms) - GREATEST(w.start_ms, t.start_ms) AS overlap_ms
FROM fx_words w JOIN fx_turns t ON w.media_id = t.media_id AND w.start_ms < t.end_ms AND t.start_ms < w.end_ms""")
def _(t):
    j = iv.interval_overlap(t.words, t.turns, M)
    return j.select("media_id", "idx", "word", "b_speaker", "start_ms", "end_ms", "overlap_ms")


@query("shared_length", """SELECT a.media_id, CAST(SUM(LEAST(a.end_ms, b.end_ms) - GREATEST(a.start_ms, b.start_ms)) AS BIGINT) AS shared_ms
FROM fx_a a JOIN fx_b b ON a.media_id = b.media_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY a.media_id""",
       fx_a=islands("fx_turns"), fx_b=islands("fx_words", rule="start_ms < top + 300"))
def _(t):
    return iv.shared_length(t.turns, iv.interval_union(t.words, M, touch=False, bridge_ms=300), M)


GAPS = """SELECT * FROM (
  SELECT a.media_id, {ident} GREATEST(a.start_ms, g.s) AS start_ms, LEAST(a.end_ms, g.e) AS end_ms
  FROM {a} a JOIN (
    SELECT media_id, end_ms AS s, LEAD(start_ms, 1, 9000000000000) OVER (PARTITION BY media_id ORDER BY start_ms) AS e FROM {u}
    UNION ALL SELECT media_id, -9000000000000, MIN(start_ms) FROM {u} GROUP BY media_id) g
  ON a.media_id = g.media_id AND a.start_ms < g.e AND g.s < a.end_ms) WHERE end_ms - start_ms > {least}"""


@query("subtract_words_from_turns", GAPS.format(ident="a.turn, a.speaker,", a="fx_turns", u="fx_u", least=0),
       fx_u=islands("fx_words"))
def _(t):
    return iv.interval_subtract(t.turns, t.words, M)


@query("long_gaps", GAPS.format(ident="", a="fx_win", u="fx_u", least=400), fx_u=islands("fx_words"),
       fx_win="SELECT media_id, 0 AS start_ms, duration_ms AS end_ms FROM fx_durations")
def _(t):
    win = t.durations.select("media_id", F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return iv.interval_gaps(win, t.words, M, 400)


@query("clip_to_windows", """SELECT t.media_id, t.speaker, t.turn, GREATEST(t.start_ms, w.a) AS start_ms, LEAST(t.end_ms, w.b) AS end_ms
FROM fx_turns t JOIN (SELECT media_id, unnest(range(0, duration_ms, 7000)) AS a, a + 5000 AS b FROM fx_durations) w
ON t.media_id = w.media_id AND t.start_ms < w.b AND w.a < t.end_ms
WHERE LEAST(t.end_ms, w.b) - GREATEST(t.start_ms, w.a) >= 20""")
def _(t):
    win = (t.durations.withColumn("start_ms", F.explode(F.expr("sequence(0L, duration_ms - 1, 7000L)")))
           .withColumn("end_ms", F.col("start_ms") + 5000))
    return iv.interval_clip(t.turns.select("media_id", "speaker", "turn", "start_ms", "end_ms"), win, M, iv.MIN_PIECE_MS)


PIECES = """SELECT p.media_id, p.s AS start_ms, p.e AS end_ms, {pick}
FROM (SELECT media_id, x AS s, LEAD(x) OVER (PARTITION BY media_id ORDER BY x) AS e
      FROM (SELECT media_id, start_ms AS x FROM {src} UNION SELECT media_id, end_ms FROM {src})) p
JOIN {src} t ON p.media_id = t.media_id AND t.start_ms <= p.s AND p.s < t.end_ms
GROUP BY p.media_id, p.s, p.e"""


@query("exclusive_turns", islands("fx_best", by="media_id, speaker"),
       fx_best=PIECES.format(src="fx_turns",
                             pick="arg_min(t.speaker, (t.start_ms - t.end_ms, t.start_ms, t.speaker)) AS speaker"))
def _(t):
    return iv.exclusive_turns(t.turns)


def moved(turns, which):
    """Gaps without losing a row: the turns in question lie long after all others."""
    later = F.expr(f"if({which}, 1000000000L, 0L)")
    return turns.withColumns({"start_ms": F.col("start_ms") + later, "end_ms": F.col("end_ms") + later})


@query("speaker_at_registry", """WITH RECURSIVE p AS (SELECT media_id, idx, (start_ms + end_ms) // 2 AS mid FROM fx_words),
c AS (SELECT p.*, t.speaker, GREATEST(t.start_ms - mid, mid - t.end_ms, 0) AS d,
        CASE WHEN t.start_ms <= mid AND mid < t.end_ms THEN 0 ELSE 1 END AS o, -t.start_ms AS tail
      FROM p LEFT JOIN fx_few t ON p.media_id = t.media_id AND mid BETWEEN t.start_ms - 500 AND t.end_ms + 500),
r AS (SELECT media_id, idx, mid, speaker, tail, RANK() OVER (PARTITION BY media_id, idx ORDER BY d, o) AS k FROM c),
g AS (SELECT media_id, idx, mid, arg_min(speaker, (tail, speaker)) AS pick, list(DISTINCT speaker) FILTER (speaker IS NOT NULL) AS tied
      FROM r WHERE k = 1 GROUP BY ALL),
q AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY mid, idx) AS n FROM g),
talk AS (SELECT media_id, arg_min(speaker, (-ms, speaker)) AS most FROM
  (SELECT media_id, speaker, SUM(end_ms - start_ms) AS ms FROM fx_few GROUP BY ALL) GROUP BY media_id),
walk AS (SELECT q.media_id, idx, n, COALESCE(pick, most, 'S1') AS speaker FROM q LEFT JOIN talk ON q.media_id = talk.media_id WHERE n = 1
  UNION ALL SELECT q.media_id, q.idx, q.n, CASE WHEN q.tied IS NULL OR list_contains(q.tied, w.speaker) THEN w.speaker ELSE q.pick END FROM walk w JOIN q ON q.media_id = w.media_id AND q.n = w.n + 1)
SELECT media_id, idx, speaker FROM walk""",
       fx_few="SELECT * REPLACE (start_ms + later AS start_ms, end_ms + later AS end_ms) FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN 1000000000 ELSE 0 END AS later FROM fx_ex)")
def _(t):
    p = t.words.select("media_id", "idx", F.expr("(start_ms + end_ms) div 2").alias("mid"))
    return iv.nearest_turn(p, moved(t.ex, "turn % 3 = 0"), "mid", ["idx"]).select("media_id", "idx", "speaker")


@query("label_words_by_turn", """WITH RECURSIVE p AS (SELECT media_id, idx, (start_ms + end_ms) // 2 AS mid FROM fx_words),
c AS (SELECT p.*, t.speaker, GREATEST(t.start_ms - mid, mid - t.end_ms, 0) AS d,
        CASE WHEN mid BETWEEN t.start_ms AND t.end_ms THEN t.start_ms - t.end_ms ELSE 1 END AS o, t.start_ms AS tail
      FROM p LEFT JOIN fx_few t ON p.media_id = t.media_id AND mid BETWEEN t.start_ms - 500 AND t.end_ms + 500),
r AS (SELECT media_id, idx, mid, speaker, tail, RANK() OVER (PARTITION BY media_id, idx ORDER BY o, d) AS k FROM c),
g AS (SELECT media_id, idx, mid, arg_min(speaker, (tail, speaker)) AS pick, list(DISTINCT speaker) FILTER (speaker IS NOT NULL) AS tied
      FROM r WHERE k = 1 GROUP BY ALL),
q AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY mid, idx) AS n FROM g),
z AS (SELECT media_id, MIN(mid) AS t0 FROM p GROUP BY media_id),
n AS (SELECT t.media_id, arg_min(t.speaker, (GREATEST(t.start_ms - t0, t0 - t.end_ms), t.start_ms, t.speaker)) AS nearest
      FROM fx_few t JOIN z ON t.media_id = z.media_id GROUP BY t.media_id),
walk AS (SELECT q.media_id, idx, q.n, COALESCE(pick, nearest, 'S1') AS speaker FROM q LEFT JOIN n ON q.media_id = n.media_id WHERE q.n = 1
  UNION ALL SELECT q.media_id, q.idx, q.n, CASE WHEN q.tied IS NULL OR list_contains(q.tied, w.speaker) THEN w.speaker ELSE q.pick END FROM walk w JOIN q ON q.media_id = w.media_id AND q.n = w.n + 1)
SELECT media_id, idx, speaker FROM walk""",
       fx_few="SELECT * REPLACE (start_ms + later AS start_ms, end_ms + later AS end_ms) FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN 1000000000 ELSE 0 END AS later FROM fx_turns)")
def _(t):
    p = t.words.select("media_id", "idx", F.expr("(start_ms + end_ms) div 2").alias("mid"))
    return (iv.nearest_turn(p, moved(t.turns, "turn % 4 = 0"), "mid", ["idx"], mode="segmenter")
            .select("media_id", "idx", "speaker"))


@query("activity_strip", """SELECT media_id, speaker, bin,
  CAST(SUM(LEAST(e, (bin + 1) * duration_ms) - GREATEST(s, bin * duration_ms)) AS DOUBLE) / ANY_VALUE(duration_ms) AS share
FROM (SELECT *, unnest(range(s // duration_ms, (e - 1) // duration_ms + 1)) AS bin FROM
  (SELECT x.media_id, speaker, duration_ms, start_ms * 120 AS s, LEAST(end_ms, duration_ms) * 120 AS e
   FROM fx_ex x JOIN fx_durations d ON x.media_id = d.media_id)) GROUP BY media_id, speaker, bin""")
def _(t):
    return iv.activity(t.ex, t.durations)


@query("covered_until", """SELECT p.media_id, p.t, COALESCE(MAX(u.end_ms), p.t) AS until_ms
FROM (SELECT media_id, unnest(range(0, duration_ms, 3000)) AS t FROM fx_durations) p
LEFT JOIN fx_u u ON p.media_id = u.media_id AND p.t BETWEEN u.start_ms AND u.end_ms GROUP BY p.media_id, p.t""",
       fx_u=islands("fx_phrases", rule="start_ms <= top + 1"))
def _(t):
    p = t.durations.select("media_id", F.explode(F.expr("sequence(0L, duration_ms - 1, 3000L)")).alias("t"))
    return iv.covered_until(p, iv.coverage(t.phrases), "t", ["t"], slack_ms=0)


@query("is_covered", """SELECT w.media_id, w.idx, bool_or(u.media_id IS NOT NULL) AS covered
FROM fx_words w LEFT JOIN fx_u u ON w.media_id = u.media_id AND u.start_ms - 1 <= w.start_ms AND w.end_ms <= u.end_ms + 1
GROUP BY w.media_id, w.idx""", fx_u=islands("fx_odd", rule="start_ms <= top + 1"),
       fx_odd="SELECT * REPLACE (start_ms + later AS start_ms, end_ms + later AS end_ms) FROM (SELECT *, CASE WHEN phrase % 3 = 1 THEN 1000000000 ELSE 0 END AS later FROM fx_phrases)")
def _(t):
    w = t.words.select("media_id", "idx", "start_ms", "end_ms")
    return iv.is_covered(w, iv.coverage(moved(t.phrases, "phrase % 3 = 1")), ["idx"]).select("media_id", "idx", "covered")


@query("split_spans", """SELECT media_id, turn, piece, start_ms + (end_ms - start_ms) * piece // n AS start_ms,
  start_ms + (end_ms - start_ms) * (piece + 1) // n AS end_ms
FROM (SELECT *, unnest(range(n)) AS piece FROM (SELECT *, (end_ms - start_ms + 11999) // 12000 AS n FROM fx_turns))""")
def _(t):
    return iv.interval_split(t.turns, 12_000).select("media_id", "turn", "piece", "start_ms", "end_ms")


@query("candidate_windows", """WITH e AS (SELECT t.media_id, t.turn, t.start_ms AS a, t.end_ms AS b, x FROM fx_turns t JOIN
   (SELECT media_id, turn, start_ms AS x FROM fx_turns UNION SELECT media_id, turn, end_ms FROM fx_turns
    UNION SELECT media_id, turn, end_ms FROM fx_words WHERE pos % 17 = 16) p USING (media_id, turn)
   WHERE t.end_ms - t.start_ms > 10000 AND p.x BETWEEN t.start_ms AND t.end_ms),
s AS (SELECT e.media_id, e.turn, e.x AS s, MAX(f.x) AS e FROM e JOIN e f USING (media_id, turn)
      WHERE f.x > e.x AND f.x - e.x <= 10000 GROUP BY ALL HAVING MAX(f.x) - e.x >= 6000),
n AS (SELECT *, GREATEST(2, (end_ms - start_ms + 9999) // 10000) AS n FROM fx_turns t WHERE end_ms - start_ms > 10000
      AND NOT EXISTS (SELECT 1 FROM s WHERE s.media_id = t.media_id AND s.turn = t.turn))
SELECT media_id, turn, start_ms, end_ms FROM fx_turns WHERE end_ms - start_ms <= 10000
UNION ALL SELECT media_id, turn, s, e FROM s
UNION ALL SELECT media_id, turn, start_ms + i * (end_ms - start_ms - 10000) // (n - 1),
  start_ms + i * (end_ms - start_ms - 10000) // (n - 1) + 10000 FROM (SELECT *, unnest(range(n)) AS i FROM n)""")
def _(t):
    p = t.words.filter("pos % 17 = 16").select("media_id", "turn", F.col("end_ms").alias("at_ms"))
    return iv.windows_at_pauses(t.turns, p, 10_000, 6_000)


@query("sweep_merge", islands("fx_pieces", by="media_id, text"), fx_pieces=PIECES.format(src="fx_turns", pick="""
  CASE WHEN COUNT(*) = 1 THEN any_value('turn ' || t.turn) ELSE
   string_agg('– turn ' || t.turn, chr(10) ORDER BY t.start_ms, t.end_ms) END AS text"""))
def _(t):
    return iv.sweep_merge(t.turns.withColumn("text", F.expr("concat('turn ', cast(turn as string))")))


@query("rolling_load", """SELECT media_id, MAX(load) AS peak FROM (SELECT media_id, CAST(SUM(conf_pct) OVER (PARTITION BY media_id
  ORDER BY end_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS BIGINT) AS load FROM fx_words) GROUP BY media_id""")
def _(t):
    return iv.rolling_load(t.words, at="end_ms", amount="conf_pct")


@query("frame_mean", """SELECT f.media_id, AVG(value) AS mean, COUNT(value) AS n FROM fx_frames f JOIN fx_u u
ON f.media_id = u.media_id AND f.frame_no * 100 + 50 >= u.start_ms AND f.frame_no * 100 + 50 < u.end_ms GROUP BY f.media_id""",
       fx_u=islands("fx_odd"), fx_odd="SELECT * REPLACE (start_ms + later AS start_ms, end_ms + later AS end_ms) FROM (SELECT *, CASE WHEN phrase % 3 = 1 THEN 1000000000 ELSE 0 END AS later FROM fx_phrases)")
def _(t):
    return iv.frame_mean(t.frames, moved(t.phrases, "phrase % 3 = 1"), M)
