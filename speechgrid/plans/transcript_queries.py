"""Transcript assembly and recognition quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as wr
from ..functions.scan import following, prev, scan, with_neighbours
from ..operators import transcript as tr
from .interval_queries import GAPS, islands
from .registry import query

M = ["media_id"]

BARE = r"""regexp_replace({w}, '["'')\]}}»”’]+$', '')"""
ABBR = ", ".join("'" + a + "'" for a in wr.ABBREVIATIONS)


def send_sql(w: str, nxt: str | None) -> str:
    """Sentence-end test as SQL."""
    b = BARE.format(w=w)
    base = f"(regexp_matches({b}, '[.?!…।]$') AND lower({b}) NOT IN ({ABBR})"
    if nxt is None:
        return base + ")"
    return base + (f" AND ({nxt} IS NULL OR NOT regexp_matches({b}, '[.…]$')"
                   f" OR NOT regexp_matches({nxt}, '^[^\\p{{L}}\\p{{N}}]*\\p{{Ll}}')))")


def core_sql(w: str) -> str:
    return f"regexp_replace(lower({w}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_'']+', '', 'g')"


SPLIT_WORD = ("CASE pos % 23 WHEN 3 THEN '17' WHEN 4 THEN '.72' WHEN 8 THEN '$' WHEN 9 THEN '5' WHEN 13 THEN '10' "
              "WHEN 14 THEN ':30' WHEN 17 THEN '1' WHEN 18 THEN ',000' WHEN 19 THEN ',500' ELSE 'w' || pos END")
SPLIT_VIEW = f"SELECT media_id, idx, {SPLIT_WORD} AS word, start_ms, end_ms, CAST(conf_pct AS DOUBLE) AS conf, pos, turn FROM fx_words"


@query("join_split_numbers", """SELECT media_id, MIN(idx) AS idx, string_agg(word, '' ORDER BY idx) AS word, MIN(start_ms) AS start_ms,
  MAX(end_ms) AS end_ms, MIN(conf) AS conf
FROM (SELECT *, idx - CASE pos % 23 WHEN 4 THEN 1 WHEN 9 THEN 1 WHEN 14 THEN 1 WHEN 18 THEN 1 WHEN 19 THEN 2 ELSE 0 END AS g
  FROM fx_split) GROUP BY media_id, g""", fx_split=SPLIT_VIEW)
def _(t):
    w = t.words.selectExpr("media_id", "idx", SPLIT_WORD + " AS word", "start_ms", "end_ms", "double(conf_pct) AS conf")
    return tr.join_split_numbers(w)


FLAGS = f"""SELECT *, {send_sql('word', 'nxt')} AS send FROM (SELECT *, LEAD(word) OVER w AS nxt, LEAD(start_ms) OVER w AS nxt_start,
  LAG(end_ms) OVER w AS prev_end FROM fx_words WINDOW w AS (PARTITION BY media_id ORDER BY idx))"""


CUTS = """SELECT media_id, k AS chunk_no, CASE WHEN MAX(CASE WHEN nxt IS NULL THEN end_ms END) <= (k + 1) * 15000
    THEN MAX(CASE WHEN nxt IS NULL THEN end_ms END)
    ELSE COALESCE(MAX(end_ms) FILTER (end_ms <= (k+1)*15000 AND send), MIN(end_ms) FILTER (end_ms > (k+1)*15000 AND send AND nxt IS NOT NULL),
      arg_max(end_ms, (nxt_start - end_ms, -end_ms)) FILTER (end_ms <= (k+1)*15000 AND nxt_start < (k+1)*15000 AND nxt_start - end_ms > 400),
      MAX(end_ms) FILTER (end_ms <= (k+1)*15000)) END AS b_ms
  FROM (SELECT *, (end_ms - 1) // 15000 AS k FROM fx_flag UNION ALL
        SELECT *, (end_ms - 1) // 15000 - 1 AS k FROM fx_flag WHERE end_ms > 15000 AND end_ms <= ((end_ms - 1) // 15000) * 15000 + 5000)
  GROUP BY media_id, k HAVING MAX(end_ms) FILTER (end_ms <= (k+1)*15000) IS NOT NULL"""
CHUNKS = """SELECT media_id, chunk_no, COALESCE(LAG(b_ms) OVER (PARTITION BY media_id ORDER BY chunk_no), 0) AS a_ms, b_ms FROM fx_cuts"""


@query("chunk_cuts", "SELECT * FROM fx_chunks", fx_flag=FLAGS, fx_cuts=CUTS, fx_chunks=CHUNKS)
def _(t):
    return tr.chunk_cuts(t.words, chunk_ms=15_000)


@query("own_words", """SELECT w.media_id, w.idx, MIN(c.chunk_no) AS chunk_no FROM fx_words w JOIN fx_chunks c ON w.media_id = c.media_id
AND w.start_ms >= c.a_ms - 50 AND w.end_ms <= c.b_ms AND w.end_ms >= c.a_ms GROUP BY w.media_id, w.idx""",
       fx_flag=FLAGS, fx_cuts=CUTS, fx_chunks=CHUNKS)
def _(t):
    w = t.words.select("media_id", "idx", "start_ms", "end_ms")
    return tr.own_words(w, tr.chunk_cuts(t.words, chunk_ms=15_000)).select("media_id", "idx", "chunk_no")


@query("word_flags", f"""SELECT media_id, idx, send AS sentence_end, regexp_matches({BARE.format(w='word')}, '[,;:—-]$') AS clause_end,
  NOT regexp_matches(word, '^[^\\p{{L}}\\p{{N}}]*\\p{{Ll}}') AS opens, regexp_matches(word, '^[^\\p{{L}}\\p{{N}}]*\\p{{Lu}}') AS capital,
  regexp_matches({BARE.format(w='word')}, '[?]$') AS question FROM fx_flag""", fx_flag=FLAGS)
def _(t):
    w = with_neighbours(t.words.select("media_id", "idx", "word"), M, "idx", nxt=("word", 1))
    return w.select("media_id", "idx", wr.sentence_end("word", "nxt").alias("sentence_end"),
                    wr.clause_end("word").alias("clause_end"), wr.opens("word").alias("opens"),
                    wr.capital("word").alias("capital"), wr.question("word").alias("question"))


@query("uncovered_speech", GAPS.format(ident="", a="fx_a", u="fx_u", least=800), fx_a=islands("fx_turns"), fx_u=islands("fx_words"))
def _(t):
    return tr.uncovered_speech(t.words, t.turns)


@query("low_confidence_runs", """SELECT media_id, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms, COUNT(*) AS n
FROM (SELECT *, idx - ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY idx) AS g FROM fx_words WHERE conf_pct < 40)
GROUP BY media_id, g HAVING COUNT(*) >= 3""")
def _(t):
    return tr.low_confidence_runs(t.words, below=40, conf="conf_pct")


LOOP_WORD = ("CASE WHEN pos % 29 BETWEEN 3 AND 4 + turn THEN 'No,' WHEN pos % 61 BETWEEN 30 AND 37 THEN CASE pos % 2 WHEN 0 THEN 'la' "
             "ELSE 'Di.' END ELSE word END")
REPEATS = """WITH RECURSIVE c AS (SELECT media_id, idx, {w} AS w FROM fx_loop),
e AS (SELECT *, {eq} FROM c WINDOW x AS (PARTITION BY media_id ORDER BY idx)),
s AS (SELECT media_id, idx, {stops} FROM e),
b AS (SELECT * FROM (SELECT media_id, idx, GREATEST({best}) AS n FROM s) WHERE n > 0),
pick AS (SELECT media_id, MIN(idx) AS idx FROM b GROUP BY media_id UNION ALL
  SELECT p.media_id, MIN(b.idx) FROM pick p JOIN b q ON q.media_id = p.media_id AND q.idx = p.idx
  JOIN b ON b.media_id = p.media_id AND b.idx >= p.idx + q.n GROUP BY p.media_id)
SELECT p.media_id, p.idx AS first_idx, b.n, f.start_ms, l.end_ms FROM pick p JOIN b USING (media_id, idx)
JOIN fx_loop f ON f.media_id = p.media_id AND f.idx = p.idx JOIN fx_loop l ON l.media_id = p.media_id AND l.idx = p.idx + b.n - 1""".format(
    w=core_sql("word"),
    eq=", ".join(f"COALESCE(w <> '' AND w = LEAD(w, {n}) OVER x, false) AS e{n}" for n in range(1, 5)),
    stops=", ".join(f"MIN(CASE WHEN NOT e{n} THEN idx END) OVER (PARTITION BY media_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND "
                    f"UNBOUNDED FOLLOWING) AS s{n}" for n in range(1, 5)),
    best=", ".join(f"CASE WHEN ((s{n} - idx) // {n} + 1) * {n} >= {max(6, 2 * n)} THEN ((s{n} - idx) // {n} + 1) * {n} ELSE 0 END"
                   for n in range(1, 5)))
LOOP_VIEW = f"SELECT media_id, idx, {LOOP_WORD} AS word, start_ms, end_ms, conf_pct, pos, turn, speaker FROM fx_words"


def loops(t):
    return t.words.selectExpr("media_id", "idx", LOOP_WORD + " AS word", "start_ms", "end_ms", "conf_pct", "pos", "turn", "speaker")


@query("repeated_phrases", REPEATS, fx_loop=LOOP_VIEW)
def _(t):
    return tr.repeated_phrases(loops(t))


@query("asr_report", """SELECT c.media_id, c.chunk_no, c.a_ms, c.b_ms,
  (SELECT COUNT(*) FROM fx_words w WHERE w.media_id = c.media_id AND w.end_ms > c.a_ms AND w.end_ms <= c.b_ms) AS words,
  COUNT(u.start_ms) AS uncovered, CAST(COALESCE(SUM(u.end_ms - u.start_ms), 0) AS BIGINT) AS uncovered_ms,
  (SELECT COUNT(*) FROM fx_low l WHERE l.media_id = c.media_id AND l.start_ms >= c.a_ms AND l.start_ms < c.b_ms) AS low_confidence,
  (SELECT CAST(COALESCE(SUM(end_ms - start_ms), 0) AS BIGINT) FROM fx_low l WHERE l.media_id = c.media_id AND l.start_ms >= c.a_ms AND l.start_ms < c.b_ms) AS low_confidence_ms,
  (SELECT COUNT(*) FROM fx_rep r WHERE r.media_id = c.media_id AND r.start_ms >= c.a_ms AND r.start_ms < c.b_ms) AS repeats,
  (SELECT CAST(COALESCE(SUM(end_ms - start_ms), 0) AS BIGINT) FROM fx_rep r WHERE r.media_id = c.media_id AND r.start_ms >= c.a_ms AND r.start_ms < c.b_ms) AS repeats_ms
FROM fx_chunks c LEFT JOIN fx_gap u ON u.media_id = c.media_id AND u.start_ms >= c.a_ms AND u.start_ms < c.b_ms
GROUP BY c.media_id, c.chunk_no, c.a_ms, c.b_ms""", fx_loop=LOOP_VIEW, fx_rep=REPEATS, fx_flag=FLAGS, fx_cuts=CUTS, fx_chunks=CHUNKS, fx_u=islands("fx_words"), fx_a=islands("fx_turns"),
       fx_gap=GAPS.format(ident="", a="fx_a", u="fx_u", least=800),
       fx_low="""SELECT media_id, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms
FROM (SELECT *, idx - ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY idx) AS g FROM fx_words WHERE conf_pct < 40)
GROUP BY media_id, g HAVING COUNT(*) >= 3""")
def _(t):
    chunks = tr.chunk_cuts(t.words, chunk_ms=15_000)
    return tr.asr_report(loops(t), t.turns, chunks, below=40, conf="conf_pct")


@query("music_flag", """SELECT u.media_id, u.id, (end_ms - start_ms >= 4000 AND m < 50 AND r.k IS NOT NULL AND NOT EXISTS (
   SELECT 1 FROM fx_turns t WHERE t.media_id = u.media_id AND t.speaker <> u.speaker AND t.start_ms < u.end_ms AND u.start_ms < t.end_ms)) AS music
FROM (SELECT media_id, turn * 10000 + pos // 24 AS id, speaker, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms,
        quantile_cont(conf_pct, 0.5) AS m FROM fx_words GROUP BY ALL) u
LEFT JOIN (SELECT media_id, turn * 10000 + pos // 24 AS id, 1 AS k FROM fx_words WHERE pos % 24 = 3 GROUP BY media_id, turn, pos // 24
           HAVING ANY_VALUE(turn) > 0) r0 ON false
LEFT JOIN (SELECT media_id, turn * 10000 + pos // 24 AS id, 1 AS k FROM fx_words WHERE pos % 24 BETWEEN 3 AND 9
           GROUP BY media_id, turn, pos // 24 HAVING COUNT(*) >= 6) r ON r.media_id = u.media_id AND r.id = u.id""")
def _(t):
    w = t.words.selectExpr("media_id", "turn * 10000 + pos div 24 AS id", "bigint(pos % 24) AS idx", "speaker", "start_ms", "end_ms",
                           "if(pos % 24 between 3 and 9, 'la', concat('w', cast(pos as string))) AS word", "double(conf_pct) AS conf")
    u = w.groupBy("media_id", "id", "speaker").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return tr.music_flag(u, w, t.turns, min_ms=4_000, conf_below=50).select("media_id", "id", "music")


@query("vet_redecode", f"""WITH v AS (SELECT media_id, turn AS gap_id, MAX(ns) AS ns, quantile_cont(conf, 0.5) AS m, MIN(idx) AS lo, MAX(idx) AS hi
  FROM fx_found GROUP BY media_id, turn),
e AS (SELECT v.*, ({core_sql('b.word')}) AS wb FROM v LEFT JOIN fx_words b ON b.media_id = v.media_id AND b.idx = v.lo - 1
   AND b.end_ms >= (SELECT start_ms FROM fx_words x WHERE x.media_id = v.media_id AND x.idx = v.lo) - 500)
SELECT f.media_id, f.turn AS gap_id, f.idx, NOT (e.ns > 0.6 OR e.m < 0.4 OR (f.idx = e.lo AND e.wb IS NOT NULL AND {core_sql('f.word')} = e.wb)) AS keep
FROM fx_found f JOIN e ON e.media_id = f.media_id AND e.gap_id = f.turn""",
       fx_found="""SELECT w.media_id, w.turn * 1000 + w.pos // 12 AS turn, w.idx, CASE WHEN w.pos % 12 = 4 AND w.turn % 2 = 0 THEN p.word ELSE 'w' || w.idx END AS word, w.conf_pct / 100.0 AS conf,
  CASE WHEN w.turn = 3 THEN 0.7 ELSE 0.1 END AS ns FROM fx_words w JOIN fx_words p ON p.media_id = w.media_id AND p.idx = w.idx - 1
  WHERE w.pos % 12 BETWEEN 4 AND 8""")
def _(t):
    w = with_neighbours(t.words, M, "idx", pw=("word", -1)).filter("pos % 12 between 4 and 8").withColumns({"at_turn": F.col("turn"), "turn": F.expr("turn * 1000 + pos div 12")})
    found = w.selectExpr("media_id", "turn AS gap_id", "idx", "if(pos % 12 = 4 and at_turn % 2 = 0, pw, concat('w', cast(idx as string))) AS word",
                         "start_ms", "end_ms", "conf_pct / 100.0D AS conf", "if(at_turn = 3, 0.7D, 0.1D) AS no_speech")
    gaps = w.groupBy("media_id", F.col("turn").alias("gap_id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    first = t.words.filter("not (pos % 12 between 4 and 8)")
    return tr.vet_redecode(found, first, gaps).select("media_id", "gap_id", "idx", "keep")


@query("transfer_marks", """SELECT media_id, idx, CASE WHEN idx % 5 = 2 THEN 'Word' || idx || '.' WHEN idx % 5 = 4 THEN 'word' || idx ELSE 'word' || idx || ',' END AS word,
  start_ms, end_ms FROM fx_words""")
def _(t):
    w = t.words.selectExpr("media_id", "idx", "if(idx % 5 = 4, 'Word', 'word') || cast(idx as string) || if(idx % 5 = 1, ',', '') as word",
                           "start_ms", "end_ms")
    styled = t.words.selectExpr("media_id", "idx", """case when idx % 5 = 2 then 'Word' || cast(idx as string) || '.'
      when idx % 5 = 4 then 'word' || cast(idx as string) else 'word' || cast(idx as string) || ',' end as word""",
                                "start_ms + 100 as start_ms", "end_ms + 100 as end_ms").filter("idx % 5 <> 1")
    return tr.transfer_marks(w, styled)


@query("drop_edge_guesses", """SELECT media_id, turn AS win, idx, CASE WHEN idx = hi THEN regexp_replace(word, '[.,?!;:…]+$', '') ELSE word END AS word
FROM (SELECT *, MIN(idx) OVER (PARTITION BY media_id, turn) AS lo, MAX(idx) OVER (PARTITION BY media_id, turn) AS hi,
  MIN(start_ms) OVER (PARTITION BY media_id, turn) AS s FROM fx_words)
WHERE NOT (idx = lo AND turn % 2 = 0 AND regexp_matches(CASE WHEN idx = hi THEN regexp_replace(word, '[.,?!;:…]+$', '') ELSE word END, '^[^\\p{L}]*\\p{Lu}')
  AND split_part(regexp_replace(lower(replace(word, '’', '''')), '[^\\p{L}\\p{M}\\p{N}_'']+', '', 'g'), '''', 1) <> 'i')""")
def _(t):
    w = t.words.selectExpr("media_id", "turn AS win", "idx", "word", "start_ms", "end_ms")
    win = w.groupBy("media_id", "win").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e")).selectExpr(
        "media_id", "win", "if(win % 2 = 0, s - 500, null) AS start_ms", "e + 500 AS end_ms")
    return tr.drop_edge_guesses(w, win).select("media_id", "win", "idx", "word")
