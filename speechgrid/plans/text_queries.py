"""Readers and stores, and text measures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import stage_folder
from ..sources import io
from .registry import query

M = ["media_id"]

EVENT = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType()), T.StructField("event", T.StringType()), T.StructField("note", T.StringType())])


def written(t, lines):
    """Write one text column as a folder of text files."""
    path = f"{stage_folder(t.spark)}/text-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def event_lines(t):
    e = t.read("events")
    # Times are numbers, quoted numbers, words and truth values; some ids are text; some lines hold two objects parted by a CR.
    time = F.expr("""case event_id % 7 when 0 then '"soon"' when 1 then concat('"', user_id, '"') when 2 then 'true' when 3 then concat(user_id, '.0') else cast(user_id as string) end""")
    rest = F.to_json(F.struct(F.col("event_type").alias("event"), F.concat(F.lit("a b"), F.col("props")).alias("note")))
    js = F.concat(F.lit('{"id": '), F.expr("""if(event_id % 19 = 0, '"x"', cast(event_id as string))"""), F.lit(', "t": '), time, F.lit(", "), F.substr(rest, F.lit(2)))
    js = F.when(F.col("event_id") % 23 == 0, F.concat(js, F.lit("\r"), js)).otherwise(js)
    torn = F.when(F.col("event_id") % 13 == 0, F.substring(js, 1, 20)).when(F.col("event_id") % 17 == 0, F.lit("[1, 2]")).otherwise(js)
    return written(t, e.select(torn.alias("value")))


@query("read_jsonl", """SELECT CASE WHEN event_id % 19 <> 0 THEN event_id END AS id, event_type AS event, length(props) + 3 AS n
FROM events, (SELECT unnest([1, 2]) AS k) WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND (k = 1 OR event_id % 23 = 0)""")
def _(t):
    return io.read_jsonl(t.spark, event_lines(t), EVENT).select("id", "event", F.length("note").alias("n"))


@query("read_trace", """SELECT CASE WHEN event_id % 19 <> 0 THEN event_id END AS id, user_id::DOUBLE AS t, event_type AS event
FROM events, (SELECT unnest([1, 2]) AS k) WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 7 >= 3 AND (k = 1 OR event_id % 23 = 0)""")
def _(t):
    return io.read_trace(t.spark, event_lines(t), EVENT).select("id", "t", "event")


@query("read_jobs", """SELECT user_id AS job, stage, done, done + 5 AS total FROM (SELECT user_id, event_type AS stage, COUNT(*) AS done FROM events GROUP BY ALL) WHERE user_id % 9 <> 0""")
def _(t):
    s = t.read("events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.count("*").alias("done"))
    doc = s.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct("done", (F.col("done") + 5).alias("total"))))).alias("stages"))
    # Every fifth document has fields of the wrong type, which must not cost the rest.
    odd = F.expr("""if(user_id % 5 = 0, '{"name": [3], "total": "many", ', '{"name": "n", "total": 4, ')""")
    js = F.concat(odd, F.substr(F.to_json(F.struct(F.col("user_id").alias("job"), "stages")), F.lit(2)))
    path = f"{stage_folder(t.spark)}/jobs-{uuid.uuid4().hex}"
    # One document a file, as a library keeps them: the folder per job comes from partitioning the write.
    doc.select(F.when(F.col("user_id") % 9 == 0, F.lit("{torn")).otherwise(js).alias("value"), "user_id").repartition("user_id").write.partitionBy("user_id").text(path)
    jobs = io.read_jobs(t.spark, f"{path}/*/*.txt", "job bigint, total bigint, name string, stages map<string, struct<done:bigint,total:bigint>>").drop("total", "name")
    return io.explode_stages(jobs, ["job"])


@query("latest_by_key", """SELECT user_id AS key, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id""")
def _(t):
    e = t.read("events").select(F.col("user_id").alias("key"), "event_id", "value", "event_type")
    return io.latest_by_key(e, ["key"], ["event_id"], {"event_type": "view"}).drop("event_type")


@query("reuse_if_inputs_match", """SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0""")
def _(t):
    d = t.read("documents")
    stored = d.select("doc_id", "lang", F.col("text").alias("transcript"), F.lit(None).cast("string").alias("synthesis"))
    today = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("transcript"), F.lit(None).cast("string").alias("synthesis"))
    return io.reuse_if_inputs_match(stored, today, ["doc_id"], ["transcript", "synthesis"]).select("doc_id", "lang")


@query("content_key", """SELECT conv_id, turn, substr(sha256('["k' || conv_id || '","' || role || '","plain"]'), 1, 20) AS key FROM conversations""")
def _(t):
    c = t.read("conversations").select("conv_id", "turn", F.expr("concat('k', cast(conv_id as string))").alias("en"), "role", F.lit("plain").alias("style"))
    return c.select("conv_id", "turn", io.content_key("en", "role", "style").alias("key"))


LINK = """CASE page_id % 10 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || vid || '&t=1h2m' || (page_id % 60) || 's' WHEN 1 THEN 'youtu.be/' || vid || '?t=' || (page_id % 500)
  WHEN 2 THEN 'https://m.youtube.com/shorts/' || vid WHEN 3 THEN 'https://www.youtube.com/live/' || vid WHEN 4 THEN 'https://youtube.com/playlist?list=x' WHEN 5 THEN url
  WHEN 6 THEN '' WHEN 7 THEN 'https://youtube.com/watch?v=short' WHEN 8 THEN 'HTTPS://YouTube.com/embed/' || vid || '?start=90' ELSE 'https://youtube-nocookie.com/v/' || vid END"""
VID = "lpad(cast((page_id % 40) * 7919 as {s}), 11, 'aB-_cD9')"
LINKS = """SELECT page_id, CASE page_id % 10 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE vid END AS video_id,
  CASE page_id % 10 WHEN 0 THEN (3720 + page_id % 60) * 1000 WHEN 1 THEN (page_id % 500) * 1000 WHEN 2 THEN 0 WHEN 8 THEN 90000 WHEN 9 THEN 0 END AS start_ms,
  CASE WHEN page_id % 10 IN (0, 1, 8, 9) THEN false WHEN page_id % 10 = 2 THEN true END AS is_short,
  CASE page_id % 10 WHEN 3 THEN 'live' WHEN 4 THEN 'playlist' WHEN 5 THEN 'other_host' WHEN 6 THEN 'empty' WHEN 7 THEN 'no_video' END AS error
FROM (SELECT *, """ + VID.format(s="varchar") + """ AS vid FROM pages)"""


def links(t):
    p = t.read("pages").select("page_id", "url", F.expr(VID.format(s="string")).alias("vid"))
    return p.select("page_id", F.expr(LINK.replace("|| (page_id % 60) ||", "|| cast(page_id % 60 as string) ||").replace("|| (page_id % 500)", "|| cast(page_id % 500 as string)")).alias("url"))


@query("media_refs", "SELECT * FROM fx_links", fx_links=LINKS)
def _(t):
    return io.media_refs(links(t)).drop("url")


@query("distinct_media", "SELECT video_id, MIN(start_ms) AS start_ms, bool_or(is_short) AS is_short, COUNT(*) AS links FROM fx_links WHERE error IS NULL GROUP BY video_id", fx_links=LINKS)
def _(t):
    return io.distinct_media(io.media_refs(links(t)))


@query("media_metadata", """SELECT doc_id, trim(lang) AS description, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS chapters,
  CASE WHEN lang = source THEN lang ELSE lang || ',' || source END AS tags FROM documents""")
def _(t):
    d = t.read("documents").select("doc_id", F.concat(F.lit("  "), "lang", F.lit(" ")).alias("description"), F.expr(
        "array(struct(if(doc_id % 2 = 0, 1.5D, null) as start_time, ' intro ' as title), struct(2.0D as start_time, if(doc_id % 3 = 0, 'x', '  ') as title))").alias("chapters"),
        F.expr("array(concat(' ', lang), source, lang, '', null)").alias("tags"))
    m = io.media_metadata(d)
    return m.select("doc_id", "description", F.size("chapters").alias("chapters"), F.array_join("tags", ",").alias("tags"))


@query("write_table", "SELECT media_id, COUNT(*) AS n, CAST(SUM(end_ms) AS BIGINT) AS total FROM fx_words GROUP BY media_id")
def _(t):
    path = f"{stage_folder(t.spark)}/words-{uuid.uuid4().hex}"
    io.write_table(t.words, path, buckets=8)
    return t.spark.read.parquet(path).groupBy("media_id").agg(F.count("*").alias("n"), F.sum("end_ms").alias("total"))


# Telugu text: each Latin letter of a unit's text as one Telugu sign.
FROM_, TO_ = "abcdefghijklmnopqrstuvwxyz", "అబచదెఫగహిజకలమనొపరరసతువ్కయ్"
TE = f"translate(regexp_replace(lower({{c}}), '[^a-z ?0-9]', ''{{g}}), '{FROM_}', '{TO_}')"
TE_SPARK, TE_DUCK = TE.format(c="text", g=""), TE.format(c="text", g=", 'g'")
AKSHARA = """GREATEST(len(regexp_extract_all(te, '[అ-ఔౠౡ]')) + len(regexp_extract_all(te, '[క-హౘ-ౚౝ]'))
  - len(regexp_extract_all(te, '్[క-హౘ-ౚౝ]')) - 0.5::DOUBLE * (len(regexp_extract_all(te, '్')) - len(regexp_extract_all(te, '్[క-హౘ-ౚౝ]'))), 0)"""


@query("count_aksharas", f"SELECT media_id, id, {AKSHARA} AS aksharas FROM (SELECT *, {TE_DUCK} AS te FROM fx_unit_text)")
def _(t):
    return t.unit_text.withColumn("te", F.expr(TE_SPARK)).select("media_id", "id", tx.count_aksharas("te").alias("aksharas"))


SYL = """CASE WHEN length(w) <= 3 THEN 1 ELSE GREATEST(g - CASE WHEN g > 1 AND ((w LIKE '%e' AND NOT regexp_matches(w, '(le|ee|ye)$'))
  OR (regexp_matches(w, 'e[sd]$') AND NOT regexp_matches(w, '(ted|ded|ses|zes|ces|ges|xes)$'))) THEN 1 ELSE 0 END, 1) END"""


@query("english_syllables", f"SELECT DISTINCT w, {SYL} AS syllables FROM (SELECT w, len(regexp_extract_all(w, '[aeiouy]+')) AS g FROM (SELECT lower(unnest(regexp_extract_all(word, '[A-Za-z]+'))) AS w FROM fx_words))")
def _(t):
    w = t.words.select(F.explode(F.regexp_extract_all(F.lower("word"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", tx.english_syllables("w").alias("syllables"))


@query("normalize_numbers", """WITH RECURSIVE u AS (SELECT * FROM (VALUES {units}) v(n, w)),
t AS (SELECT unnest(range(0, 100)) AS n), b AS (SELECT t.n, CASE WHEN t.n < 20 THEN a.w WHEN t.n % 10 = 0 THEN x.w ELSE x.w || ' ' || r.w END AS w FROM t LEFT JOIN u a ON a.n = t.n
  LEFT JOIN (SELECT * FROM (VALUES {tens}) v(n, w)) x ON x.n = t.n // 10 LEFT JOIN u r ON r.n = t.n % 10),
h AS (SELECT n, CASE WHEN n < 100 THEN (SELECT w FROM b WHERE b.n = k.n) WHEN n = 100 THEN 'వంద' WHEN n < 200 THEN 'నూట ' || (SELECT w FROM b WHERE b.n = k.n % 100)
  WHEN n % 100 = 0 THEN (SELECT w FROM b WHERE b.n = k.n // 100) || ' వందలు' ELSE (SELECT w FROM b WHERE b.n = k.n // 100) || ' వందల ' || (SELECT w FROM b WHERE b.n = k.n % 100) END AS w
  FROM (SELECT unnest(range(0, 1000)) AS n) k)
SELECT media_id, id, z.n, CASE WHEN z.n < 1000 THEN h.w WHEN z.n < 2000 THEN 'వెయ్యి' ELSE q.w || CASE WHEN z.n % 1000 = 0 THEN ' వేలు' ELSE ' వేల' END END
  || CASE WHEN z.n >= 1000 AND z.n % 1000 > 0 THEN ' ' || h.w ELSE '' END || ' రూపాయలు సున్నా పాయింట్ ఐదు సున్నా శాతం.' AS spoken
FROM (SELECT media_id, id, (id * 7 + conf_sum) % 90000 AS n FROM fx_units) z LEFT JOIN h ON h.n = z.n % 1000 LEFT JOIN b q ON q.n = z.n // 1000""".format(
    units=", ".join(f"({i}, '{w}')" for i, w in enumerate(tx.UNITS)), tens=", ".join(f"({i}, '{w}')" for i, w in enumerate(tx.TENS, 2))))
def _(t):
    u = t.units.selectExpr("media_id", "id", "(id * 7 + conf_sum) % 90000 AS n")
    return u.select("media_id", "id", "n", tx.normalize_numbers(F.expr("concat('Rs. ', cast(n as string), ', 0.౫0%  .')")).alias("spoken")).withColumn("spoken", F.replace("spoken", F.lit(" ."), F.lit(".")))


@query("spoken_units", f"SELECT media_id, id, {AKSHARA} AS units FROM (SELECT media_id, id, regexp_replace({TE_DUCK}, '[0-9]', '', 'g') AS te FROM fx_unit_text)")
def _(t):
    return t.unit_text.withColumn("te", F.regexp_replace(F.expr(TE_SPARK), "[0-9]", "")).select("media_id", "id", tx.spoken_units("te").alias("units"))


@query("mixed_units", f"""SELECT u.media_id, u.id, {AKSHARA} + COALESCE(s.n, 0) AS units FROM (SELECT media_id, id, regexp_replace({TE_DUCK}, '[0-9]', '', 'g') AS te FROM fx_unit_text) u
LEFT JOIN (SELECT media_id, id, SUM({SYL}) AS n FROM (SELECT media_id, id, w, len(regexp_extract_all(w, '[aeiouy]+')) AS g FROM (
  SELECT media_id, id, lower(unnest(regexp_extract_all(regexp_replace(text, '[0-9'']', '', 'g'), '[A-Za-z]+'))) AS w FROM fx_unit_text)) GROUP BY ALL) s ON s.media_id = u.media_id AND s.id = u.id""")
def _(t):
    both = F.concat_ws(" ", F.regexp_replace(F.expr(TE_SPARK), "[0-9]", ""), F.regexp_replace("text", "[0-9']", ""))
    return t.unit_text.select("media_id", "id", tx.mixed_units(both).alias("units"))


LATIN = "[A-Za-zÀ-ÖØ-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ''’-]*"


@query("latin_ratio", f"""SELECT media_id, id, CASE WHEN l + e > 0 THEN l::DOUBLE / (l + e) ELSE 0.0 END AS ratio FROM (SELECT media_id, id, len(regexp_extract_all(text, '{LATIN}')) AS l,
  len(regexp_extract_all({TE_DUCK}, '[ఀ-౿]+')) AS e FROM fx_unit_text)""")
def _(t):
    return t.unit_text.select("media_id", "id", tx.latin_ratio(F.concat_ws(" ", "text", F.expr(TE_SPARK))).alias("ratio"))
