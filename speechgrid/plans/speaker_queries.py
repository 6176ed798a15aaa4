"""Speaker analytics and entity linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dot, unit_vector
from ..operators import speakers as sp
from .interval_queries import islands
from .registry import query

M = ["media_id"]


@query("unit_vectors", """SELECT vec_id, CASE WHEN vec_id % 17 <> 0 THEN embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) END AS first,
  vec_id % 17 <> 0 AS usable FROM embeddings""")
def _(t):
    e = t.read("embeddings").withColumn("v", F.expr("case when vec_id % 17 = 0 then transform(embedding, (x, i) -> if(i = 3, double('NaN'), double(x))) else transform(embedding, x -> double(x)) end"))
    u = e.select("vec_id", unit_vector("v").alias("u"))
    return u.select("vec_id", F.col("u")[0].alias("first"), F.col("u").isNotNull().alias("usable"))


BLOCK_TURNS = "SELECT media_id, turn // 2 AS block_no, 'L' || speaker AS label, start_ms, end_ms FROM fx_turns"


def block_turns(t):
    return t.turns.selectExpr("media_id", "turn div 2 AS block_no", "concat('L', speaker) AS label", "start_ms", "end_ms")


@query("shared_speech", """SELECT a.media_id, a.block_no, a.label, b.speaker, CAST(SUM(LEAST(a.end_ms, b.end_ms) - GREATEST(a.start_ms, b.start_ms)) AS BIGINT) AS ms
FROM fx_bt a JOIN fx_ex b ON a.media_id = b.media_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY ALL""", fx_bt=BLOCK_TURNS)
def _(t):
    return sp.shared_speech(block_turns(t), t.ex)


def voices(t):
    """A voice print per (recording, speaker, block): an embedding of the speaker's own group."""
    e = t.read("embeddings").selectExpr("label AS grp", "vec_id", "transform(embedding, x -> double(x)) AS centroid")
    g = t.ex.select("media_id", "speaker", F.expr("turn div 2").alias("block_no")).distinct().withColumn("grp", F.expr("(media_id + length(speaker)) % 10"))
    first = e.groupBy("grp").agg(F.min_by("centroid", "vec_id").alias("centroid"))
    return g.join(first, "grp").select("media_id", "block_no", F.expr("concat('L', speaker)").alias("label"), "centroid")


def blocks(t):
    b = t.ex.groupBy("media_id", F.expr("turn div 2").alias("block_no")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return b.selectExpr("media_id", "block_no", "greatest(start_ms - 3000, 0) AS start_ms", "end_ms")


@query("link_speakers")
def _(t):
    turns = t.ex.selectExpr("media_id", "turn div 2 AS block_no", "concat('L', speaker) AS label", "start_ms", "end_ms")
    return sp.link_speakers(blocks(t), turns, voices(t))


@query("merge_centroids", """SELECT label, list_sum(list_transform(range(1, 65), lambda i: v[i] * v[i])) BETWEEN 0.999999 AND 1.000001 AS unit_length, round(list_sum(list_transform(range(1, 65), lambda i: i * v[i])), 4) AS by_place, round(v[1], 5) AS first, round(v[64], 5) AS last,
  CAST(w AS BIGINT) AS weight_ms FROM (
  SELECT label, list(1.0::DOUBLE) AS one, (SELECT list(x / n ORDER BY i) FROM (SELECT i, SUM(e.embedding[i] * (100 + e.vec_id)) AS x FROM embeddings e, range(1, 65) r(i) WHERE e.label = o.label GROUP BY i),
   (SELECT sqrt(SUM(x * x)) AS n FROM (SELECT i, SUM(e.embedding[i] * (100 + e.vec_id)) AS x FROM embeddings e, range(1, 65) r(i) WHERE e.label = o.label GROUP BY i))) AS v, SUM(100 + vec_id) AS w
  FROM embeddings o GROUP BY label)""")
def _(t):
    e = t.read("embeddings").selectExpr("label", "transform(embedding, x -> double(x)) AS centroid", "100 + vec_id AS talk_ms")
    m = sp.merge_centroids(e, ["label"])
    by_place = F.expr("aggregate(transform(centroid, (x, i) -> (i + 1) * x), 0D, (a, x) -> a + x)")
    return m.select("label", dot("centroid", "centroid").between(0.999999, 1.000001).alias("unit_length"), F.round(by_place, 4).alias("by_place"), F.round(F.col("centroid")[0], 5).alias("first"),
                    F.round(F.col("centroid")[63], 5).alias("last"), F.col("weight_ms").cast("bigint").alias("weight_ms"))


@query("remap_speakers", islands("fx_new", by="media_id, speaker", rule="start_ms <= top + 1"),
       fx_new="SELECT media_id, CASE WHEN speaker IN ('user', 'system') THEN 'S1' ELSE speaker END AS speaker, start_ms, end_ms FROM fx_turns")
def _(t):
    ids = t.turns.select("media_id", "speaker").distinct().filter("speaker in ('user', 'system')").withColumn("new_speaker", F.lit("S1"))
    return sp.remap_speakers(t.turns, ids)


@query("rename_collisions", """SELECT media_id, 'S1' AS speaker, COUNT(DISTINCT speaker) AS n FROM fx_turns WHERE speaker IN ('user', 'system') GROUP BY media_id HAVING COUNT(DISTINCT speaker) > 1""")
def _(t):
    ids = t.turns.select("media_id", "speaker").distinct().filter("speaker in ('user', 'system')").withColumn("new_speaker", F.lit("S1"))
    return sp.rename_collisions(t.turns, ids)


def speaker_rows(t):
    x = t.ex.withColumn("speaker", F.expr("concat('S', cast(turn % 5 + 1 as string))"))
    e = t.read("embeddings").groupBy(F.col("label").alias("grp")).agg(F.min_by(F.expr("transform(embedding, x -> double(x))"), "vec_id").alias("centroid"))
    g = x.groupBy("media_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"), F.min("start_ms").alias("first_ms"))
    g = g.withColumn("grp", F.expr("if(media_id % 3 = 0, null, (media_id + length(speaker) + cast(substr(speaker, 2) as int) div 3) % 10)"))
    return x, g.join(e, "grp", "left").drop("grp")


@query("settle_speakers")
def _(t):
    x, g = speaker_rows(t)
    return sp.settle_speakers(g, x)


@query("match_ids", """WITH cur AS (SELECT media_id, speaker, MIN(start_ms) AS f FROM fx_ex GROUP BY ALL),
sh AS (SELECT a.media_id, a.speaker, b.speaker AS old, CAST(SUM(LEAST(a.end_ms, b.end_ms) - GREATEST(a.start_ms, b.start_ms)) AS BIGINT) AS ms FROM fx_ex a JOIN fx_old b ON a.media_id = b.media_id
   AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY ALL),
o AS (SELECT media_id, speaker, f, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY f) AS k FROM cur),
opt AS (SELECT o.media_id, o.k, o.speaker, sh.old, sh.ms FROM o JOIN sh ON sh.media_id = o.media_id AND sh.speaker = o.speaker UNION ALL SELECT media_id, k, speaker, NULL, 0 FROM o),
a AS (SELECT x.media_id, x.old AS o1, y.old AS o2, z.old AS o3, x.ms + COALESCE(y.ms, 0) + COALESCE(z.ms, 0) AS total FROM (SELECT * FROM opt WHERE k = 1) x
  LEFT JOIN (SELECT * FROM opt WHERE k = 2) y ON y.media_id = x.media_id AND (y.old IS NULL OR y.old IS DISTINCT FROM x.old)
  LEFT JOIN (SELECT * FROM opt WHERE k = 3) z ON z.media_id = x.media_id AND (z.old IS NULL OR (z.old IS DISTINCT FROM x.old AND z.old IS DISTINCT FROM y.old))),
b AS (SELECT media_id, arg_min({'o1': o1, 'o2': o2, 'o3': o3}, (-total, COALESCE(o1, 'Z'), COALESCE(o2, 'Z'), COALESCE(o3, 'Z'))) AS p FROM a GROUP BY media_id),
p AS (SELECT o.media_id, o.speaker, o.k, CASE o.k WHEN 1 THEN p.o1 WHEN 2 THEN p.o2 ELSE p.o3 END AS old FROM o JOIN b ON b.media_id = o.media_id)
SELECT p.media_id, p.speaker, COALESCE(old, 'S' || (m.hi + SUM(CASE WHEN old IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.media_id ORDER BY k))) AS new_speaker
FROM p JOIN (SELECT media_id, MAX(CAST(substr(speaker, 2) AS INT)) AS hi FROM fx_old GROUP BY media_id) m ON m.media_id = p.media_id""",
       fx_old="SELECT media_id, 'S' || (turn % 4 + 1) AS speaker, start_ms, end_ms FROM fx_ex")
def _(t):
    return sp.match_ids(t.ex.withColumn("speaker", F.expr("concat('S', cast(turn % 4 + 1 as string))")), t.ex)


@query("talk_stats", """SELECT *, talk_ms::DOUBLE / SUM(talk_ms) OVER (PARTITION BY media_id) AS share FROM (
  SELECT media_id, speaker, CAST(SUM(end_ms - start_ms) AS BIGINT) AS talk_ms, MIN(start_ms) AS first_ms, COUNT(*) AS turns FROM fx_ex GROUP BY media_id, speaker)""")
def _(t):
    return sp.talk_stats(t.ex)


KEYGAPS = """SELECT * FROM (SELECT a.media_id, a.speaker, a.k, GREATEST(a.start_ms, g.s) AS start_ms, LEAST(a.end_ms, g.e) AS end_ms FROM {a} a JOIN (
    SELECT media_id, speaker, k, end_ms AS s, LEAD(start_ms, 1, 9000000000000) OVER (PARTITION BY media_id, speaker, k ORDER BY start_ms) AS e FROM {u}
    UNION ALL SELECT media_id, speaker, k, -9000000000000, MIN(start_ms) FROM {u} GROUP BY ALL) g ON a.media_id = g.media_id AND a.speaker = g.speaker AND a.k = g.k AND a.start_ms < g.e AND g.s < a.end_ms)
WHERE end_ms > start_ms UNION ALL SELECT media_id, speaker, k, start_ms, end_ms FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {u} u WHERE u.media_id = a.media_id AND u.speaker = a.speaker AND u.k = a.k)"""
COVER = """SELECT a.media_id, a.speaker, a.k, o.start_ms - 300 AS start_ms, o.end_ms + 300 AS end_ms FROM {a} a JOIN fx_turns o ON o.media_id = a.media_id AND o.speaker <> a.speaker
AND o.start_ms - 300 < a.end_ms AND a.start_ms < o.end_ms + 300"""
EARLY = """SELECT media_id, speaker, start_ms, LEAST(end_ms, 20000) AS end_ms, 1 AS late FROM {a} WHERE start_ms < 20000 UNION ALL
SELECT media_id, speaker, GREATEST(start_ms, 20000), end_ms, 0 FROM {a} WHERE end_ms > 20000"""
SPLIT = """SELECT media_id, speaker, late, start_ms + (end_ms - start_ms) * i // n AS start_ms, start_ms + (end_ms - start_ms) * (i + 1) // n AS end_ms FROM (
  SELECT *, unnest(range(n)) AS i FROM (SELECT *, (end_ms - start_ms + {size} - 1) // {size} AS n FROM {a} WHERE end_ms > start_ms))"""
ISO = """SELECT c.*, LEAST(2000, COALESCE((SELECT MIN(GREATEST(o.start_ms - c.end_ms, c.start_ms - o.end_ms, 0)) FROM fx_turns o WHERE o.media_id = c.media_id AND o.speaker <> c.speaker
   AND o.start_ms < c.end_ms + 2000 AND c.start_ms - 2000 < o.end_ms), 2000)) AS iso,
  COALESCE((SELECT CAST(SUM(LEAST(o.end_ms, c.end_ms) - GREATEST(o.start_ms, c.start_ms)) AS BIGINT) FROM fx_phrases o WHERE o.media_id = c.media_id AND o.speaker = c.speaker AND o.start_ms < c.end_ms AND c.start_ms < o.end_ms), 0) AS v
  FROM {a} c WHERE end_ms - start_ms >= 2000"""
CLIPS = dict(fx_own="SELECT media_id, speaker, start_ms AS k, start_ms + 300 AS start_ms, end_ms - 300 AS end_ms FROM fx_phrases WHERE end_ms - start_ms >= 2000",
             fx_cov=COVER.format(a="fx_own"), fx_covu=islands("fx_cov", by="media_id, speaker, k"), fx_free=KEYGAPS.format(a="fx_own", u="fx_covu"),
             fx_early=EARLY.format(a="fx_free"), fx_split=SPLIT.format(a="fx_early", size=12000), fx_iso=ISO.format(a="fx_split"))


@query("reference_clips", """SELECT media_id, speaker, rank, start_ms, end_ms, score FROM (SELECT *, COALESCE(SUM(end_ms - start_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, ROW_NUMBER() OVER w AS rank
 FROM (SELECT *, (10 * LEAST(end_ms - start_ms, 8000) * 2000 + 3 * iso * 8000) / (10.0::DOUBLE * 8000 * 2000) AS score FROM fx_iso) WINDOW w AS (PARTITION BY media_id, speaker ORDER BY late, score DESC, start_ms, end_ms)) WHERE b < 10000""", **CLIPS)
def _(t):
    return sp.reference_clips(t.phrases, t.turns, avoid_ms=20_000)


STRETCH = dict(fx_run=islands("fx_phrases", by="media_id, speaker", rule="start_ms <= top OR (start_ms <= top + 600 AND (start_ms <= 30001 OR top >= 30999))"),
               fx_runk="SELECT media_id, speaker, start_ms AS k, start_ms, end_ms FROM fx_run", fx_cov=COVER.format(a="fx_runk"), fx_covu=islands("fx_cov", by="media_id, speaker, k"),
               fx_free=KEYGAPS.format(a="fx_runk", u="fx_covu"),
               fx_pz="""SELECT media_id, speaker, (top + start_ms) // 2 AS mid, top, start_ms FROM (SELECT *, MAX(end_ms) OVER (PARTITION BY media_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM fx_phrases)
               WHERE start_ms > top AND start_ms <= top + 600 AND (start_ms <= 30001 OR top >= 30999)""")


def two_blocks(t):
    return t.durations.selectExpr("media_id", "inline(array(struct(0L AS start_ms, 30000L AS end_ms), struct(31000L AS start_ms, greatest(duration_ms, 31001L) AS end_ms)))")


@query("clean_stretches", """SELECT media_id, speaker, start_ms, end_ms, (SELECT COUNT(*) FROM fx_pz p WHERE p.media_id = f.media_id AND p.speaker = f.speaker AND p.mid > f.start_ms AND p.mid < f.end_ms) AS pauses,
  COALESCE((SELECT CAST(SUM(mid) AS BIGINT) FROM fx_pz p WHERE p.media_id = f.media_id AND p.speaker = f.speaker AND p.mid > f.start_ms AND p.mid < f.end_ms), 0) AS pause_sum FROM fx_free f""", **STRETCH)
def _(t):
    x = sp.clean_stretches(t.phrases, two_blocks(t), t.turns)
    return x.selectExpr("media_id", "speaker", "start_ms", "end_ms", "size(pauses) AS pauses", "aggregate(pauses, 0L, (a, p) -> a + p) AS pause_sum")


@query("clean_clips", """SELECT media_id, speaker, rank, CASE WHEN end_ms - start_ms > room THEN (start_ms + end_ms - room) // 2 ELSE start_ms END AS start_ms,
  CASE WHEN end_ms - start_ms > room THEN (start_ms + end_ms - room) // 2 + room ELSE end_ms END AS end_ms, score FROM (
 SELECT *, 15000 - COALESCE(SUM(end_ms - start_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, ROW_NUMBER() OVER w AS rank FROM (
  SELECT *, round((10 * LEAST(v, 8000) * 2000 + 3 * iso * 8000) / (10.0::DOUBLE * 8000 * 2000), 6) AS score FROM fx_iso) WINDOW w AS (PARTITION BY media_id, speaker ORDER BY late, score DESC, start_ms, end_ms)) WHERE room >= 2000""",
       **STRETCH, fx_early=EARLY.format(a="fx_free"), fx_split=SPLIT.format(a="fx_early", size=10000), fx_iso=ISO.format(a="fx_split"))
def _(t):
    return sp.clean_clips(sp.clean_stretches(t.phrases, two_blocks(t), t.turns), t.phrases, t.turns, total_ms=15_000, avoid_ms=20_000)


@query("best_span")
def _(t):
    return sp.best_span(sp.span_candidates(sp.clean_stretches(t.phrases, two_blocks(t), t.turns), t.phrases, t.turns))


@query("best_span_scored")
def _(t):
    c = sp.span_candidates(sp.clean_stretches(t.phrases, two_blocks(t), t.turns), t.phrases, t.turns)
    return sp.best_span(c.withColumn("extra", F.expr("if((start_ms + end_ms) % 3 = 0, double('NaN'), (start_ms % 97) / 100D)")), score_col="extra")


@query("voice_still_owned", """WITH u AS (SELECT media_id, speaker, CAST(SUM(ms) AS BIGINT) AS own FROM (SELECT a.media_id, a.speaker, LEAST(a.end_ms, b.end_ms) - GREATEST(a.start_ms, b.start_ms) AS ms
  FROM fx_spanu a JOIN fx_ex b ON a.media_id = b.media_id AND a.speaker = b.speaker AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms) GROUP BY ALL)
SELECT s.media_id, s.speaker, COALESCE(own, 0) AS own_ms, speech_ms, COALESCE(own, 0) >= 0.9 * speech_ms AS valid FROM (SELECT media_id, speaker, CAST(SUM(end_ms - start_ms) AS BIGINT) AS speech_ms FROM fx_ex GROUP BY ALL) s
LEFT JOIN u ON u.media_id = s.media_id AND u.speaker = s.speaker""", fx_sp="SELECT media_id, speaker, start_ms - 4000 AS start_ms, end_ms - CASE WHEN media_id % 2 = 0 THEN 9000 ELSE 0 END AS end_ms FROM fx_ex",
       fx_spanu=islands("fx_sp", by="media_id, speaker"))
def _(t):
    spans = t.ex.selectExpr("media_id", "speaker", "start_ms - 4000 AS start_ms", "end_ms - if(media_id % 2 = 0, 9000, 0) AS end_ms")
    stored = t.ex.groupBy("media_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    return sp.voice_still_owned(spans, stored, t.ex)


@query("pitch_vote", """SELECT media_id, speaker, CASE WHEN p * 10 >= 1000 AND p >= 0.2 * n AND lo >= 0.8 * p THEN 'male' WHEN p * 10 >= 1000 AND p >= 0.2 * n AND hi >= 0.8 * p THEN 'female' ELSE 'unresolved' END AS range, m AS median_hz
FROM (SELECT media_id, speaker, COUNT(*) AS n, COUNT(hz) AS p, COUNT(*) FILTER (hz BETWEEN 70 AND 160) AS lo, COUNT(*) FILTER (hz BETWEEN 190 AND 350) AS hi, quantile_cont(hz, 0.5) AS m FROM (
  SELECT media_id, speaker, CASE WHEN pos % 3 > 0 THEN (90 + conf_pct % 60 + CASE WHEN length(speaker) > 5 THEN 110 ELSE 0 END)::DOUBLE END AS hz FROM fx_words) GROUP BY ALL)""")
def _(t):
    f = t.words.selectExpr("media_id", "speaker", "if(pos % 3 > 0, double(90 + conf_pct % 60 + if(length(speaker) > 5, 110, 0)), null) AS hz")
    return sp.pitch_vote(f, min_voiced_ms=1_000)


@query("speakers_report", """SELECT x.media_id, x.speaker, x.talk_ms, x.first_ms, x.turns, x.talk_ms::DOUBLE / SUM(x.talk_ms) OVER (PARTITION BY x.media_id) AS share, 120 AS bins
FROM (SELECT media_id, speaker, CAST(SUM(end_ms - start_ms) AS BIGINT) AS talk_ms, MIN(start_ms) AS first_ms, COUNT(*) AS turns FROM fx_ex GROUP BY media_id, speaker) x""")
def _(t):
    r = sp.speakers_report(t.ex, t.durations)
    return r.withColumn("bins", F.size("activity")).drop("activity")
