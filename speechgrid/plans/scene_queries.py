"""Scenes, batching and subtitle cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cues as cu
from ..operators import scenes as sc
from ..operators import transcript as tr
from .interval_queries import PIECES, islands
from .registry import query
from .transcript_queries import CHUNKS, CUTS, FLAGS

M = ["media_id"]

SEQ = "SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY start_ms, id) - 1 AS seq FROM fx_unit_text"
SCENES = """WITH RECURSIVE k AS (SELECT a.media_id, a.seq, a.start_ms AS s0, b.seq - a.seq AS i, b.end_ms AS e, b.speaker AS sp, c.speaker AS nsp, c.start_ms AS ns, c.seq AS nseq
  FROM fx_seq a JOIN fx_seq b ON b.media_id = a.media_id AND b.seq BETWEEN a.seq AND a.seq + 5 LEFT JOIN fx_seq c ON c.media_id = a.media_id AND c.seq = b.seq + 1),
f AS (SELECT media_id, seq, COALESCE(MIN(i) FILTER (e - s0 > 30000), MAX(i) + 1) AS fit, COUNT(*) AS have, bool_or(nseq IS NULL) AS tail FROM k GROUP BY ALL),
h AS (SELECT k.media_id, k.seq, COALESCE(MAX(i) FILTER (i < fit AND (e - s0) * 2 < 30000), 0) AS low FROM k JOIN f USING (media_id, seq) GROUP BY ALL),
n AS (SELECT f.media_id, f.seq, CASE WHEN fit = 0 THEN 1 WHEN tail AND fit = have AND fit < 6 THEN fit ELSE COALESCE((
   SELECT MAX(i) + 1 FROM k WHERE k.media_id = f.media_id AND k.seq = f.seq AND i BETWEEN 1 AND fit - 1 AND i > low AND (nseq IS NULL OR nsp <> sp OR ns - e >= 1000)), fit) END AS n
  FROM f JOIN h USING (media_id, seq)),
w AS (SELECT media_id, seq, n, 1 AS scene FROM n WHERE seq = 0 UNION ALL SELECT w.media_id, n.seq, n.n, w.scene + 1 FROM w JOIN n ON n.media_id = w.media_id AND n.seq = w.seq + w.n)
SELECT w.media_id, w.seq, w.n, a.start_ms, b.end_ms, w.scene FROM w JOIN fx_seq a ON a.media_id = w.media_id AND a.seq = w.seq JOIN fx_seq b ON b.media_id = w.media_id AND b.seq = w.seq + w.n - 1"""
SV = dict(fx_seq=SEQ, fx_scene=SCENES)


@query("scene_cut", "SELECT * FROM fx_scene", **SV)
def _(t):
    return sc.scene_cut(sc.number_units(t.units))


@query("scene_context", """SELECT s.media_id, s.scene,
  (SELECT string_agg(text || '|' || COALESCE(CASE WHEN id % 3 > 0 THEN 't' || id END, '-'), chr(10) ORDER BY seq) FROM fx_seq u WHERE u.media_id = s.media_id AND u.seq >= s.seq - 3 AND u.seq < s.seq AND u.end_ms >= s.start_ms - 60000) AS before,
  (SELECT string_agg(text, chr(10) ORDER BY seq) FROM fx_seq u WHERE u.media_id = s.media_id AND u.seq >= s.seq + s.n AND u.seq < s.seq + s.n + 2 AND u.start_ms <= s.end_ms + 60000) AS after FROM fx_scene s""", **SV)
def _(t):
    u = sc.number_units(t.unit_text).withColumn("chosen", F.expr("if(id % 3 > 0, concat('t', cast(id as string)), null)"))
    x = sc.scene_context(sc.scene_cut(u), u)
    b = "array_join(transform(before, x -> concat(x.text, '|', coalesce(x.chosen, '-'))), '\n')"
    return x.selectExpr("media_id", "scene", f"if(size(before) = 0, null, {b}) AS before", "if(size(after) = 0, null, array_join(after, '\n')) AS after")


@query("lanes", """SELECT media_id, scene, CASE WHEN n < 3 THEN scene - 1 WHEN scene - 1 < e1 THEN 0 WHEN scene - 1 < GREATEST(e1 + 1, LEAST(CAST(floor(n * (4.0::DOUBLE / 5)) AS BIGINT), n - 1)) THEN 1 ELSE 2 END AS lane
FROM (SELECT *, GREATEST(1, LEAST(CAST(floor(n * (3.0::DOUBLE / 5)) AS BIGINT), n - 2)) AS e1 FROM (SELECT media_id, scene, COUNT(*) OVER (PARTITION BY media_id) AS n FROM fx_scene))""", **SV)
def _(t):
    return sc.lanes(sc.scene_cut(sc.number_units(t.units)), (3.0, 1.0, 1.0)).select("media_id", "scene", "lane")


@query("length_ratio", """SELECT media_id, speaker, CASE WHEN MAX(r) >= 3 THEN quantile_cont(CASE WHEN ok AND r > mx - 400 THEN u / n_words::DOUBLE END, 0.5) ELSE 1.4 END AS k, CAST(MAX(r) AS BIGINT) AS n
FROM (SELECT *, MAX(r) OVER (PARTITION BY media_id, speaker) AS mx FROM (SELECT media_id, speaker, n_words, n_words >= 4 AS ok, (end_ms - start_ms) // 100 AS u,
  SUM(CASE WHEN n_words >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, speaker ORDER BY start_ms, id ROWS UNBOUNDED PRECEDING) AS r FROM fx_units)) GROUP BY media_id, speaker""")
def _(t):
    return sc.length_ratio(t.units.selectExpr("media_id", "speaker", "start_ms", "id", "(end_ms - start_ms) div 100 AS units", "n_words AS syllables"))


@query("line_specs", """SELECT media_id, id, tgt AS target_units, pf AS pred_full, CASE WHEN pf > 1.1::DOUBLE * tgt THEN 'full,concise,very_concise' WHEN pf < 0.85::DOUBLE * tgt AND sp >= 0.8::DOUBLE * (end_ms - start_ms)
   THEN 'full,fuller' ELSE 'full' END AS want FROM (SELECT *, GREATEST(sp / 1000 - 0.15::DOUBLE, 0) * 6.1::DOUBLE AS tgt, 1.4::DOUBLE * n_words * 2 AS pf FROM (SELECT *, (end_ms - start_ms) * (60 + id % 41) // 100 AS sp FROM fx_units))""")
def _(t):
    x = t.units.selectExpr("media_id", "id", "start_ms", "end_ms", "(end_ms - start_ms) * (60 + id % 41) div 100 AS speech_ms", "6.1D AS rate", "0.15D AS overhead", "1.4D AS k", "n_words * 2 AS syllables")
    return sc.line_specs(x).selectExpr("media_id", "id", "target_units", "pred_full", "array_join(want, ',') AS want")


PICK = """SELECT media_id, id, (end_ms - start_ms) AS sp, (end_ms - start_ms) + id % 800 AS b, id % 17 = 0 AS ok, k, ['fuller', 'full', 'concise', 'very_concise'][k] AS tier,
  (end_ms - start_ms) * (170 - k * (25 + id % 20) + id % 23) // 100 AS p FROM fx_units, (SELECT unnest(range(1, 5)) AS k) WHERE k = 2 OR (id + k) % 3 > 0"""


@query("pick_tier", """WITH g AS (SELECT media_id, id, bool_or(ok) AS ok, arg_min(tier, k) FILTER (p >= 0.85 * sp AND p <= 1.1 * sp) AS i, arg_min(tier, (p, k)) FILTER (p > 1.1 * sp) AS up,
   arg_min(p <= b * 1.2, (p, k)) FILTER (p > 1.1 * sp) AS a, arg_max(tier, (p, -k)) FILTER (p < 0.85 * sp) AS dn, bool_or((p >= 0.85 * sp AND p <= 1.1 * sp) OR p <= b * 1.2) FILTER (k = 2) AS ff FROM fx_pick GROUP BY media_id, id)
SELECT media_id, id, CASE WHEN ok THEN 'full' WHEN i IS NOT NULL THEN i WHEN COALESCE(a, false) OR dn IS NULL THEN up ELSE dn END AS tier,
  CASE WHEN ok THEN ff ELSE i IS NOT NULL OR COALESCE(a, false) END AS fits FROM g""", fx_pick=PICK)
def _(t):
    k = t.units.selectExpr("media_id", "id", "start_ms", "end_ms", "explode(array(1, 2, 3, 4)) AS k").filter("k = 2 or (id + k) % 3 > 0")
    tiers = k.selectExpr("media_id", "id", "array('fuller', 'full', 'concise', 'very_concise')[k - 1] AS tier", "(end_ms - start_ms) * (170 - k * (25 + id % 20) + id % 23) div 100 AS pred_ms")
    ln = t.units.selectExpr("media_id", "id", "end_ms - start_ms AS speech_ms", "end_ms - start_ms + id % 800 AS budget_ms", "id % 17 = 0 AS approved_full")
    return sc.pick_tier(tiers, ln)


@query("fit_requests", """SELECT media_id, id, CASE WHEN id % 10 = 9 THEN '' WHEN over THEN CASE WHEN id % 2 = 0 THEN 'concise,very_concise' ELSE 'concise' END
  WHEN id % 3 = 0 THEN CASE WHEN tier = 'full' THEN 'fuller' WHEN tier = 'concise' AND id % 2 = 0 THEN 'concise' ELSE 'concise' END ELSE CASE WHEN tier = 'full' THEN 'fuller' ELSE 'concise' END END AS want
FROM (SELECT media_id, id, 'full' AS tier, id % 4 = 0 AS over FROM fx_units)""")
def _(t):
    x = t.units.selectExpr("media_id", "id", "start_ms", "end_ms", "'full' AS tier", "if(id % 2 = 0, array('full'), array('full', 'very_concise')) AS have",
                                                "map('full', double((end_ms - start_ms) * if(id % 4 = 0, 2, 0.5))) AS pred_ms", "map('full', 20.0D) AS units",
                                                "end_ms - start_ms AS speech_ms", "15.0D AS target_units", "id % 10 = 9 AS approved_full")
    return sc.fit_requests(x).selectExpr("media_id", "id", "array_join(want, ',') AS want")


ROWS8 = """SELECT media_id, chunk_no, CAST(SUM(n_words) AS BIGINT) AS words FROM (SELECT u.media_id, n_words, COALESCE((SELECT MAX(chunk_no) FROM fx_chunks c WHERE c.media_id = u.media_id AND c.a_ms <= u.start_ms),
   (SELECT MIN(chunk_no) FROM fx_chunks c WHERE c.media_id = u.media_id)) AS chunk_no FROM fx_units u) GROUP BY ALL"""


@query("brief_parts", """WITH RECURSIVE o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY chunk_no) AS k FROM fx_rows),
w AS (SELECT media_id, chunk_no, words, k, words AS acc, 1 AS part FROM o WHERE k = 1
  UNION ALL SELECT o.media_id, o.chunk_no, o.words, o.k, CASE WHEN acc + o.words > 120 THEN o.words ELSE acc + o.words END, CASE WHEN acc + o.words > 120 THEN part + 1 ELSE part END
  FROM w JOIN o ON o.media_id = w.media_id AND o.k = w.k + 1)
SELECT media_id, chunk_no, words, part FROM w""", fx_flag=FLAGS, fx_cuts=CUTS, fx_chunks=CHUNKS, fx_rows=ROWS8)
def _(t):
    return sc.brief_parts(t.units, tr.chunk_cuts(t.words, chunk_ms=15_000), words=120)


WIDTHS = """SELECT media_id, id, u.speaker, w.pos, w.word, w.start_ms, w.end_ms, length(w.word) AS c, SUM(length(w.word) + 1) OVER (PARTITION BY media_id, id ORDER BY w.pos) - 1 AS upto,
  SUM(length(w.word) + 1) OVER (PARTITION BY media_id, id) - 1 AS whole, ROW_NUMBER() OVER (PARTITION BY media_id, id ORDER BY w.pos) AS k, COUNT(*) OVER (PARTITION BY media_id, id) AS n
  FROM fx_unit_text u JOIN (SELECT *, turn * 10000 + pos // 8 AS id FROM fx_words) w USING (media_id, id)"""


@query("layout_rows", """SELECT media_id, id, CASE WHEN ANY_VALUE(whole) <= 42 OR ANY_VALUE(n) = 1 THEN string_agg(word, ' ' ORDER BY pos) ELSE
   CASE WHEN MIN(cut) IS NOT NULL THEN string_agg(word || CASE WHEN k = n THEN '' WHEN k = cut THEN chr(10) ELSE ' ' END, '' ORDER BY pos) END END AS rows
FROM (SELECT *, arg_min(CASE WHEN upto <= 42 AND whole - upto - 1 <= 42 THEN k END, CASE WHEN k < n AND upto <= 42 AND whole - upto - 1 <= 42 THEN (abs(upto - whole / 2), k) END) OVER (PARTITION BY media_id, id) AS cut FROM fx_wid)
GROUP BY media_id, id""", fx_wid=WIDTHS)
def _(t):
    return cu.layout_rows(t.unit_text.selectExpr("media_id", "id", "transform(words, w -> w.word) AS words")).select("media_id", "id", "rows")


@query("source_cues")
def _(t):
    return cu.source_cues(t.unit_text)


@query("target_cues")
def _(t):
    ln = t.plans.join(t.unit_text.select("media_id", "id", F.col("text").alias("spoken")), ["media_id", "id"])
    return cu.target_cues(ln, F.length)


CUES = "SELECT media_id, id, speaker, start_ms, CASE WHEN id % 3 = 0 THEN start_ms + 300 ELSE end_ms END AS end_ms, 'l' || id AS text FROM fx_plans"
SHAPED = """SELECT media_id, id, speaker, start_ms, end_ms, text FROM (SELECT media_id, id, speaker, text, s AS start_ms, LEAST(CASE WHEN end_ms - s < 700 THEN GREATEST(end_ms, COALESCE(LEAST(s + 700, nxt), s + 700)) ELSE end_ms END, 60000) AS end_ms FROM
 (SELECT *, (SELECT MIN(GREATEST(x.start_ms, 1000)) FROM fx_cue x WHERE x.media_id = c.media_id AND x.end_ms > 1000 AND GREATEST(x.start_ms, 1000) > c.s) AS nxt FROM
  (SELECT *, GREATEST(start_ms, 1000) AS s FROM fx_cue WHERE end_ms > 1000) c)) WHERE end_ms > start_ms"""


def some_cues(t):
    return t.plans.selectExpr("media_id", "id", "speaker", "start_ms", "if(id % 3 = 0, start_ms + 300, end_ms) AS end_ms", "concat('l', cast(id as string)) AS text")


# Every fourth recording is a preview of a minute, every third begins at its first second; all others are shaped whole.
BOUNDS = "CASE WHEN media_id % 4 = 0 THEN 60000 END AS stop, CASE WHEN media_id % 3 = 0 THEN 1000 END AS floor"


@query("shape_cues", f"""SELECT media_id, id, speaker, start_ms, end_ms, text FROM (SELECT media_id, id, speaker, text, s AS start_ms,
   LEAST(CASE WHEN end_ms - s < 700 THEN GREATEST(end_ms, COALESCE(LEAST(s + 700, nxt), s + 700)) ELSE end_ms END, COALESCE(stop, 9e15::BIGINT)) AS end_ms FROM
  (SELECT c.*, (SELECT MIN(x.s) FROM fx_from x WHERE x.media_id = c.media_id AND x.s > c.s) AS nxt FROM fx_from c)) WHERE end_ms > start_ms""", fx_cue=CUES,
       fx_from=f"SELECT *, GREATEST(start_ms, COALESCE(floor, start_ms)) AS s FROM (SELECT *, {BOUNDS} FROM fx_cue) WHERE floor IS NULL OR end_ms > floor")
def _(t):
    x = some_cues(t).selectExpr("*", "if(media_id % 4 = 0, 60000L, null) AS stop", "if(media_id % 3 = 0, 1000L, null) AS floor")
    return cu.shape_cues(x, stop_ms="stop", floor_ms="floor").drop("stop", "floor")


SHAPED0 = SHAPED.replace("1000", "0").replace("LEAST(CASE WHEN end_ms - s", "(CASE WHEN end_ms - s").replace("ELSE end_ms END, 60000)", "ELSE end_ms END)")


@query("subtitle_track", "SELECT media_id, start_ms, end_ms - start_ms AS duration_ms, text FROM fx_track", fx_cue=CUES, fx_shaped=SHAPED0,
       fx_track=islands("fx_piece", by="media_id, text"), fx_spk=PIECES.replace("GROUP BY p.media_id, p.s, p.e", "GROUP BY p.media_id, p.s, p.e, t.speaker").format(
           src="fx_shaped", pick="t.speaker, string_agg(t.text, chr(10) ORDER BY t.start_ms, t.end_ms) AS block, MIN((t.start_ms, t.end_ms)) AS began"),
       fx_piece="""SELECT media_id, start_ms, end_ms, CASE WHEN COUNT(*) = 1 THEN MIN(block) ELSE string_agg('– ' || block, chr(10) ORDER BY began, speaker) END AS text
       FROM fx_spk GROUP BY media_id, start_ms, end_ms""")
def _(t):
    return cu.subtitle_track(some_cues(t))
