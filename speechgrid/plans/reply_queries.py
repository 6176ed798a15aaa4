"""Reply quality rules on replies derived from the units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replies as rp
from .registry import query
from .text_queries import AKSHARA, TE_DUCK, TE_SPARK

M = ["media_id"]

# Replies: ids as JSON text with copies, booleans, strings and fractions among them.
RID = """CASE WHEN id % 29 = 0 THEN 'true' WHEN id % 31 = 0 THEN '"' || id || '"' WHEN id % 23 = 0 THEN id || '.5' WHEN id % 7 = 0 THEN id || '.0' ELSE CAST(id AS VARCHAR) END"""
REPLIES = f"""SELECT media_id, id AS src, {RID} AS id_json FROM fx_units WHERE id % 19 <> 0 UNION ALL SELECT media_id, id, CAST(id AS VARCHAR) FROM fx_units WHERE id % 37 = 0
UNION ALL SELECT media_id, id, CAST(id + 5000 AS VARCHAR) FROM fx_units WHERE id % 41 = 0"""
WHOLE = "CASE WHEN regexp_matches(id_json, '^-?[0-9]+(\\.0+)?$') THEN CAST(regexp_replace(id_json, '\\.0+$', '') AS BIGINT) END"


def reply_ids(t):
    u = t.units
    rid = RID.replace("|| id ||", "|| cast(id as string) ||").replace("THEN id ||", "THEN cast(id as string) ||").replace("VARCHAR", "STRING")
    a = u.filter("id % 19 <> 0").selectExpr("media_id", "id AS src", f"{rid} AS id_json")
    return (a.unionByName(u.filter("id % 37 = 0").selectExpr("media_id", "id AS src", "cast(id as string) AS id_json"))
            .unionByName(u.filter("id % 41 = 0").selectExpr("media_id", "id AS src", "cast(id + 5000 as string) AS id_json")))


@query("reconcile", f"""WITH r AS (SELECT media_id, {WHOLE} AS id, id_json FROM fx_replies), k AS (SELECT media_id, id, COUNT(*) AS n, MIN(id_json) AS id_json FROM r WHERE id IS NOT NULL GROUP BY ALL)
SELECT COALESCE(k.media_id, s.media_id) AS media_id, COALESCE(k.id, s.id) AS id, k.id_json, COALESCE(n, 0) AS n, CASE WHEN s.id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS status
FROM k FULL JOIN fx_units s ON s.media_id = k.media_id AND s.id = k.id UNION ALL SELECT media_id, NULL, id_json, COUNT(*), 'unexpected' FROM r WHERE id IS NULL GROUP BY media_id, id_json""", fx_replies=REPLIES)
def _(t):
    return rp.reconcile(reply_ids(t), t.units)


def te(t):
    """Units with Telugu text and some of the ways it goes wrong."""
    return t.unit_text.withColumn("te", F.expr(TE_SPARK)).withColumn("te", F.expr(
        "case id % 6 when 1 then concat(te, ' కొ(త్త)') when 2 then concat(te, ' chesi Hello') when 3 then concat('  ', te, '  пр') when 4 then concat(te, ' 12 %') else te end"))


TEV = f"""SELECT *, CASE id % 6 WHEN 1 THEN te0 || ' కొ(త్త)' WHEN 2 THEN te0 || ' chesi Hello' WHEN 3 THEN '  ' || te0 || '  пр' WHEN 4 THEN te0 || ' 12 %' ELSE te0 END AS te
FROM (SELECT *, {TE_DUCK} AS te0 FROM fx_unit_text)"""


@query("script_problems", """SELECT media_id, id, array_to_string(list_sort(list_filter([CASE WHEN id % 6 = 1 THEN 'brackets in' END, CASE WHEN id % 6 = 2 THEN 'Latin letters in' END,
  CASE WHEN id % 6 = 2 THEN 'romanised Telugu in' END, CASE WHEN id % 6 = 3 THEN 'Cyrillic letters in' END, CASE WHEN regexp_matches(te, '[0-9]') THEN 'digits in' END,
  CASE WHEN id % 6 = 4 THEN 'symbols in' END, CASE WHEN NOT regexp_matches(te, '[అ-హౘ-ౡ]') THEN 'no Telugu' END], lambda x: x IS NOT NULL)), ',') AS kinds FROM fx_te""", fx_te=TEV)
def _(t):
    p = F.array_join(F.array_sort(F.transform(rp.script_problems("te"), lambda r: r["kind"])), ",")
    return te(t).select("media_id", "id", p.alias("kinds"))


@query("repair_text", """SELECT media_id, id, trim(regexp_replace(te, ' +', ' ', 'g')) AS te, id % 2 = 0 AS repaired FROM (SELECT media_id, id, te || ' క్క' AS te FROM fx_te)""", fx_te=TEV)
def _(t):
    x = te(t).withColumn("te", F.concat("te", F.expr("if(id % 2 = 0, ' క్‌క', ' క్క')")))
    return x.select("media_id", "id", rp.repair_text("te").alias("te"), rp.was_repaired("te").alias("repaired"))


def anchored(t):
    """Lines whose second and third token have an English word; some anchors are wrong."""
    x = t.unit_text.withColumn("spoken", F.expr("concat('నమ కర ', if(id % 4 = 0, 'నెట్ఫ్లిక్స్లో', 'కర'), ', కర యమ')"))
    return x.withColumn("english", F.expr("""array(struct('కర' as word, 1 as occurrence, 'car' as en), struct(if(id % 3 = 0, null, 'యమ') as word, 0 as occurrence, if(id % 5 = 0, 'two words', 'gem') as en),
      struct('నమ' as word, 3 as occurrence, 'name' as en), struct('నెట్ఫ్లిక్స్లో,' as word, 0 as occurrence, 'Netflix' as en))"""))


@query("resolve_anchors", """SELECT media_id, id, CASE WHEN id % 4 = 0 THEN '2:Netflix,3:car' ELSE '3:car' END || CASE WHEN id % 3 = 0 THEN '' WHEN id % 5 = 0 THEN ',4:two words' ELSE ',4:gem' END AS map FROM fx_units""")
def _(t):
    m = F.transform(rp.resolve_anchors("spoken", "english"), lambda e: F.concat(e["i"].cast("string"), F.lit(":"), e["en"]))
    return anchored(t).select("media_id", "id", F.array_join(m, ",").alias("map"))


@query("latin_line", """SELECT media_id, id, 'నమ కర ' || CASE WHEN id % 4 = 0 THEN 'నెట్ఫ్లిక్స్లో,' ELSE 'కర,' END || ' car ' || CASE WHEN id % 3 = 0 THEN 'యమ' WHEN id % 5 = 0 THEN 'two words' ELSE 'gem' END AS line FROM fx_units""")
def _(t):
    x = anchored(t).withColumn("m", rp.resolve_anchors("spoken", "english"))
    return x.select("media_id", "id", rp.latin_line("spoken", "m").alias("line"))


@query("anchor_rows", """SELECT media_id, id, 'కర/' || CASE WHEN id % 4 = 0 THEN 1 ELSE 1 END || CASE WHEN id % 3 = 0 THEN '' ELSE ',యమ/0' END AS rows FROM fx_units""")
def _(t):
    x = anchored(t).withColumn("m", rp.resolve_anchors("spoken", "english"))
    r = F.transform(rp.anchor_rows("spoken", "m"), lambda e: F.concat(e["word"], F.lit("/"), e["occurrence"].cast("string")))
    return x.select("media_id", "id", F.array_join(r, ",").alias("rows"))


@query("map_flags", """SELECT media_id, id, CASE WHEN id % 3 = 0 THEN '1:unanchored,' WHEN id % 5 = 0 THEN '1:must be one English word,' ELSE '' END || '2:not found' || CASE WHEN id % 4 = 0 THEN ',3:keeps its ending' ELSE ',3:not found' END AS flags FROM fx_units""")
def _(t):
    f = F.transform(rp.map_flags("spoken", "english"), lambda r: F.concat(r["place"].cast("string"), F.lit(":"), r["flag"]))
    return anchored(t).select("media_id", "id", F.array_join(f, ",").alias("flags"))


@query("code_mix_index", """SELECT media_id, 100.0::DOUBLE * LEAST(e, w - e) / w AS cmi FROM (SELECT media_id, COUNT(*) * 5 AS w, SUM(1 + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END) AS e FROM fx_units GROUP BY media_id)""")
def _(t):
    return rp.code_mix_index(anchored(t).withColumn("english", rp.resolve_anchors("spoken", "english")), M)


def tiered(t):
    return t.unit_text.withColumn("te", F.concat(F.lit("మనమ "), F.expr(TE_SPARK))).select("media_id", "id", F.expr(
        "map('full', te, 'concise', concat(te, if(id % 3 = 0, ' క', '')), 'very_concise', substr(te, 1, 4), 'fuller', concat(te, if(id % 4 = 0, '', ' మమ')))").alias("tiers"),
        F.array(F.lit("full"), F.lit("concise")).alias("want"))


@query("order_tiers", f"""SELECT media_id, id, CASE WHEN id % 4 = 0 THEN 'full' ELSE 'full,fuller' END || CASE WHEN n > 3 THEN ',very_concise' ELSE '' END AS kept,
  'concise dropped' || CASE WHEN n > 3 THEN '' ELSE ',very_concise dropped' END || CASE WHEN id % 4 = 0 THEN ',fuller dropped' ELSE '' END || ',concise missing' AS flags
FROM (SELECT media_id, id, {AKSHARA} AS n FROM (SELECT media_id, id, 'మనమ ' || {TE_DUCK} AS te FROM fx_unit_text))""")
def _(t):
    x = rp.order_tiers(tiered(t))
    return x.select("media_id", "id", F.array_join(F.array_sort(F.map_keys("kept")), ",").alias("kept"), F.array_join("tier_flags", ",").alias("flags"))


@query("check_pieces", """SELECT media_id, id, CASE id % 5 WHEN 0 THEN 'the line has no breaks' WHEN 1 THEN 'they don''t join back to full' WHEN 2 THEN 'not a list of wordings' WHEN 3 THEN 'more pieces than breaks' END AS flag,
  CASE WHEN id % 5 = 4 THEN 2 ELSE 0 END AS pieces, CASE WHEN id % 5 = 4 THEN 1 ELSE 0 END AS moved FROM fx_units""")
def _(t):
    x = t.units.selectExpr("media_id", "id", "'క మ న' AS spoken", "case id % 5 when 1 then array('క', 'మ') when 2 then array('క', null) when 3 then array('క', 'మ', 'న') else array(' క', 'మ  న') end AS pieces",
                           "array('so', ' ') AS moved", "if(id % 5 = 0, cast(array() as array<int>), array(3)) AS breaks")
    return rp.check_pieces(x).selectExpr("media_id", "id", "piece_flag AS flag", "size(pieces) AS pieces", "size(moved) AS moved")


@query("check_delivery", """SELECT media_id, id, CASE WHEN id % 2 = 0 THEN 'happy' ELSE 'neutral' END AS emotion, CASE WHEN id % 3 = 0 THEN 'mid' ELSE 'high' END AS energy, id % 5 = 0 AS question,
  CASE WHEN id % 7 IN (1, 2) THEN '0,' || id % 7 ELSE '0' END AS emphasis, array_to_string(list_filter([CASE WHEN id % 2 = 1 THEN 'emotion unknown' END, CASE WHEN id % 3 = 0 THEN 'energy unknown' END, CASE WHEN id % 7 >= 3 THEN 'emphasis is not a word' END], lambda x: x IS NOT NULL), ',') AS flags
FROM fx_units""")
def _(t):
    x = t.units.selectExpr("media_id", "id", "'క మ న' AS spoken", """struct(if(id % 2 = 0, 'happy', 'odd') as emotion, if(id % 3 = 0, 'huge', 'high') as energy,
      case id % 5 when 0 then 'true' when 1 then '1' end as question, array(0, int(id % 7), 0) as emphasis) AS delivery""")
    return rp.check_delivery(x).select("media_id", "id", "delivery.emotion", "delivery.energy", "delivery.question", F.array_join(F.transform("delivery.emphasis", lambda i: i.cast("string")), ",").alias("emphasis"),
                                       F.array_join("delivery_flags", ",").alias("flags"))


# Every word as it stands, and what is no ASCII word: runs of accented letters from inside words, and marks.
TERMS = """SELECT DISTINCT media_id, unnest([word, regexp_extract(word, '[À-ÿ]+'), regexp_extract(word, '[.,!?]+$'), regexp_extract(word, '.[À-ÿ][.,]')]) AS term FROM fx_words"""


@query("glossary_flags", """SELECT DISTINCT u.media_id, u.id, g.term FROM fx_unit_text u JOIN fx_terms g ON g.media_id = u.media_id AND g.term <> '' AND contains(lower(u.text), lower(g.term))
  AND regexp_matches(u.text, '(?i)(^|[^A-Za-z0-9])' || regexp_escape(g.term) || '($|[^A-Za-z0-9])')
WHERE NOT (u.id % 2 = 0)""", fx_terms=TERMS)
def _(t):
    forms = F.array("word", F.regexp_extract("word", "[À-ÿ]+", 0), F.regexp_extract("word", "[.,!?]+$", 0), F.regexp_extract("word", ".[À-ÿ][.,]", 0))
    g = t.words.select("media_id", F.explode(forms).alias("term")).distinct().withColumn("spoken", F.lit("పద"))
    ln = t.unit_text.select("media_id", "id", F.col("text").alias("source"), F.expr("if(id % 2 = 0, 'పద', 'క')").alias("spoken"))
    return rp.glossary_flags(ln, g)


@query("glossary_entries", """SELECT media_id, arg_min(trim(word), idx) AS term, 'పద' AS spoken, arg_min(idx % 3 <> 0, idx) AS keep_english, '' AS note FROM fx_words WHERE idx % 7 <> 0 GROUP BY media_id, lower(word)""")
def _(t):
    x = t.words.selectExpr("media_id", "idx AS pos", "concat(' ', word) AS term", "if(idx % 7 = 0, 'bad', ' పద ') AS spoken", "if(idx % 3 = 0, false, null) AS keep_english", "cast(null as string) AS note")
    return rp.glossary_entries(x)


# Numbers of a line's text. Runs of digits, commas and points that no letter (or letter and hyphen) stands before, each with a letter
# after it; letters and hyphens are doubled first, so that one between two runs is seen by both. Of a run, what is followed by no
# letter and no further digit is the number. The reply says five or nothing: a number begins with five where its leading group of
# units, hundreds, thousands or lakhs does.
NUMBER_RUNS = """list_filter(regexp_extract_all(regexp_replace(text, '([A-Za-z-])', '\\1\\1', 'g'), '(?:[A-Za-z](?:--)?)?[0-9.,]+[A-Za-z]?'), lambda x: regexp_matches(x, '^[0-9]'))"""
NUMBER_OF = """regexp_replace(regexp_extract(replace(regexp_extract(x, '^([0-9][0-9,]*(?:[.][0-9]+)?)(?:$|[.,](?:$|[^0-9]))', 1), ',', ''), '^[0-9]+'), '^0+([0-9])', '\\1')"""
IS_FIVE = "(v LIKE '5%' AND (length(v) - 1) % 7 + 1 IN (1, 3, 4, 6))"
OTHERS = "|".join(w for w in rp.NUMBER_VALUES if w != "five")


@query("meaning_flags", f"""SELECT media_id, id, array_to_string(list_filter([CASE WHEN (regexp_matches(text, '(?i)\\b(not|never|no|nobody|nothing|none|nowhere|neither|nor|cannot|without)\\b') OR regexp_matches(text, '(?i)n[''’]t\\b')) <> (id % 3 = 0) THEN 'negation' END,
  CASE WHEN contains(text, '?') <> (id % 4 = 0) THEN 'question' END,
  CASE WHEN regexp_matches(low, '\\b({OTHERS})\\b') OR (id % 3 = 0 AND regexp_matches(low, '\\bfive\\b'))
    OR len(list_filter(numbers, lambda v: v <> '' AND NOT (id % 3 <> 0 AND {IS_FIVE}))) > 0 THEN 'number' END], lambda x: x IS NOT NULL), ',') AS flags
FROM (SELECT media_id, id, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, list_transform({NUMBER_RUNS}, lambda x: {NUMBER_OF}) AS numbers FROM fx_unit_text)""")
def _(t):
    x = t.unit_text.select("media_id", "id", F.col("text").alias("source"), F.expr("concat(if(id % 3 = 0, 'అది లేదు', 'అది ఐదు'), if(id % 4 = 0, '?', ''))").alias("spoken"))
    return x.select("media_id", "id", F.array_join(rp.meaning_flags("source", "spoken", F.expr("cast(array() as array<string>)")), ",").alias("flags"))


@query("unsaid_numbers", """SELECT media_id, id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '25' WHEN 2 THEN '25,Three' ELSE 'Three' END AS missing FROM fx_units""")
def _(t):
    x = t.units.selectExpr("media_id", "id", "'We saw 25 dogs, Three cats, the 3rd one and A4' AS source", "case id % 4 when 0 then 'ఇరవై ఐదు మూడు' when 1 then 'మూడేళ్ళు' when 2 then 'కుక్క' else 'ఇరవై' end AS spoken")
    return x.select("media_id", "id", F.array_join(rp.unsaid_numbers("source", "spoken", F.expr("if(id < 0, array('x'), cast(array() as array<string>))")), ",").alias("missing"))


@query("check_replies")
def _(t):
    u = te(t)
    r = reply_ids(t).join(u.select("media_id", F.col("id").alias("src"), "te"), ["media_id", "src"]).withColumns({
        "tiers": F.expr("map('full', te, 'concise', substr(te, 1, 6))"), "english": F.expr("cast(array() as array<struct<word:string,occurrence:int,en:string>>)"),
        "pieces": F.expr("cast(array() as array<string>)"), "moved": F.expr("cast(array() as array<string>)"),
        "delivery": F.expr("struct('happy' as emotion, 'mid' as energy, cast(null as string) as question, cast(array() as array<int>) as emphasis)")})
    s = t.unit_text.select("media_id", "id", F.col("text").alias("source"), F.array(F.lit("full"), F.lit("concise")).alias("want"), F.expr("cast(array() as array<int>)").alias("breaks"))
    g = t.words.filter("word rlike '^[A-Za-z]+$' and length(word) > 6").select("media_id", F.col("word").alias("term")).distinct().withColumn("spoken", F.lit("పద"))
    return rp.check_replies(r, s, g)


@query("check_verdicts", f"""WITH v AS (SELECT media_id, {WHOLE} AS id, src FROM fx_replies), g AS (SELECT media_id, id, COUNT(*) AS n, MIN(src) AS src FROM v WHERE id IS NOT NULL GROUP BY ALL),
x AS (SELECT s.media_id, s.id, n, src, (['C', 'm', 'P', 'E', 'Z'])[src % 5 + 1] AS c FROM fx_units s LEFT JOIN g ON g.media_id = s.media_id AND g.id = s.id),
y AS (SELECT *, CASE WHEN n IS NULL THEN 'missing from the review' WHEN n > 1 THEN 'returned ' || n || ' times' WHEN c = 'Z' THEN 'class unknown' WHEN c = 'C' AND src % 2 = 1 THEN 'complete verdict contradicts its findings' END AS why FROM x)
SELECT media_id, id, CASE WHEN why IS NULL THEN c END AS cls, CASE WHEN why IS NULL THEN CASE WHEN src % 2 = 1 THEN 'a' ELSE '' END END AS missing,
  CASE WHEN why IS NULL AND c = 'E' THEN CASE WHEN src % 3 = 0 THEN 'number' ELSE 'other' END END AS error, why FROM y""", fx_replies=REPLIES)
def _(t):
    v = reply_ids(t).selectExpr("media_id", "id_json", "array('C', 'm', 'P', 'E', 'Z')[int(src % 5)] AS cls", "if(src % 2 = 1, array('a', ' a ', ''), cast(array() as array<string>)) AS missing",
                                "cast(array() as array<string>) AS added", "if(src % 5 = 0, 'none', if(src % 3 = 0, 'number', 'odd')) AS error")
    x = rp.check_verdicts(v, t.units, strict=True)
    return x.select("media_id", "id", "cls", F.when(F.col("missing").isNotNull(), F.array_join("missing", ",")).alias("missing"), "error", "why")


@query("fallback_ok", """SELECT media_id, id, id % 5 = 0 AND id % 3 > 0 AND NOT regexp_matches(text, '(?i)\\b(may|might|could|can|should|would|perhaps|maybe|probably|possibly|likely|unlikely|apparently|reportedly|seem(s|ed|ing)?|appear(s|ed|ing)?|approximately|roughly|estimated|about|rare(ly)?|usually|sometimes|often|almost|nearly)\\b') AS approved FROM fx_unit_text""")
def _(t):
    x = t.unit_text.select("media_id", "id", F.col("text").alias("source"), F.expr("""case id % 5 when 0 then '{"class": "C", "missing": [], "added": [], "error": "none"}' when 1 then '{"class": "C", "missing": [], "error": "none"}'
      when 2 then '{"class": "m", "missing": [], "added": [], "error": "none"}' when 3 then 'junk' end""").alias("fallback"))
    twice = x.filter("id % 3 = 0")
    return rp.fallback_ok(x.unionByName(twice))


REDO = """SELECT media_id, id, (['C', 'm', 'P', 'E'])[id % 4 + 1] AS cls, id % 5 = 0 AS newflag, id % 7 = 0 AS oldflag, CASE WHEN id % 3 > 0 THEN (['C', 'm', 'P'])[id % 3 + 1] END AS sem, id % 11 = 0 AS clash FROM fx_units"""


def redo(t):
    x = t.units.selectExpr("media_id", "id", "array('C', 'm', 'P', 'E')[int(id % 4)] AS cls", "if(id % 5 = 0, array('negation'), cast(array() as array<string>)) AS new_flags",
                           "if(id % 7 = 0, array('negation'), cast(array() as array<string>)) AS old_flags", "array('C', 'm', 'P', 'E')[int(id % 4)] AS before_cls", "'negation' AS before_error",
                           "if(id % 3 > 0, array('C', 'm', 'P')[int(id % 3)], null) AS sem_cls", "if(id % 11 = 0, array('x'), cast(array() as array<string>)) AS sem_missing", "cast(array() as array<string>) AS sem_added",
                           "cast(null as string) AS sem_error")
    return rp.redo_verdict(x)


REDOV = """SELECT *, newflag AND (NOT oldflag OR cls = 'E') AS hit FROM fx_redo0"""
REDOC = "SELECT *, CASE WHEN hit THEN 'E' WHEN sem = 'C' AND clash THEN NULL ELSE sem END AS rc, CASE WHEN hit THEN 'validators' WHEN sem IS NOT NULL AND NOT (sem = 'C' AND clash) THEN 'review' END AS rb FROM fx_redo1"
RV = dict(fx_redo0=REDO, fx_redo1=REDOV, fx_redo2=REDOC)


@query("redo_verdict", "SELECT media_id, id, rc AS redo_cls, rb AS redo_by FROM fx_redo2", **RV)
def _(t):
    return redo(t).select("media_id", "id", "redo_cls", "redo_by")


@query("choose_wording", """SELECT media_id, id, CASE WHEN b THEN 'new' ELSE 'original' END AS chosen, CASE WHEN b THEN 'accepted' WHEN NOT has THEN CASE WHEN id % 2 = 0 THEN 'call_error' ELSE 'no_valid_candidate' END
  WHEN rc IS NULL THEN CASE WHEN id % 9 = 0 THEN 'review_error' ELSE 'review_missing' END WHEN rc = 'E' AND rb = 'validators' THEN 'meaning_flag' ELSE 'not_better' END AS outcome
FROM (SELECT *, id % 13 <> 0 AS has, id % 13 <> 0 AND COALESCE(list_position(['C', 'm', 'P', 'E'], rc), 5) < list_position(['C', 'm', 'P', 'E'], cls) AS b FROM fx_redo2)""", **RV)
def _(t):
    x = redo(t).withColumns({"has_candidate": F.expr("id % 13 <> 0"), "call_failed": F.expr("id % 2 = 0"), "review_failed": F.expr("id % 9 = 0")})
    return rp.choose_wording(x).select("media_id", "id", "chosen", "outcome")


@query("voiced_class", """SELECT media_id, id, CASE WHEN id % 6 = 0 THEN 'unreviewed' WHEN id % 4 = 1 THEN 'other_tier' ELSE (['C', 'P'])[id % 2 + 1] END AS cls,
  CASE WHEN id % 6 = 0 THEN 'unreviewed' WHEN id % 4 = 1 THEN 'other_tier' WHEN id % 5 = 0 THEN 'E' ELSE (['C', 'P'])[id % 2 + 1] END AS first_cls FROM fx_units""")
def _(t):
    x = t.units.selectExpr("media_id", "id", "if(id % 6 = 0, null, array('C', 'P')[int(id % 2)]) AS c", "if(id % 4 = 1, 'concise', 'full') AS vt", "'full' AS tier", "if(id % 5 = 0, 'validators', 'review') AS vb", "'E' AS fc")
    return x.select("media_id", "id", rp.voiced_class("c", "vt", "tier", "vb", "fc").alias("cls"), rp.voiced_class("c", "vt", "tier", "vb", "fc", True).alias("first_cls"))


@query("merge_fit", """SELECT media_id, id, CASE WHEN id % 5 = 0 THEN 'full=కమనలర' WHEN id % 3 = 0 THEN 'full=కమనలర' ELSE 'concise=కమ,full=కమనలర' END AS tiers, CASE WHEN id % 5 > 0 AND id % 3 = 0 THEN 'concise' ELSE '' END AS left_out,
  CASE WHEN id % 5 > 0 AND id % 3 > 0 AND id % 2 = 0 THEN NULL ELSE 'P' END AS cls FROM fx_units""")
def _(t):
    u = t.units
    s = u.selectExpr("media_id", "id", "map('full', 'కమనలర') AS tiers", "'P' AS cls", "if(id % 2 = 0, 'concise', 'full') AS cls_tier", "id % 5 = 0 AS approved_full")
    f = u.selectExpr("media_id", "id", "array('concise') AS want", "map('concise', if(id % 3 = 0, 'కమనలరసత', 'కమ'), 'fuller', 'కమనలరసతప') AS fit_tiers")
    x = rp.merge_fit(s, f, ["media_id", "id"])
    show = F.array_join(F.array_sort(F.transform(F.map_entries("tiers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return x.select("media_id", "id", show.alias("tiers"), F.array_join("left_out", ",").alias("left_out"), "cls")


@query("cached_lines", """SELECT s.media_id, s.id, brief, CASE WHEN policy = 'p1' AND NOT (cls IN ('C', 'm') AND vb <> 'review') THEN cls END AS cls FROM (
  SELECT media_id, id % 400 AS k, arg_max(id % 3, id) AS brief, arg_max(CASE WHEN id % 2 = 0 THEN 'p1' ELSE 'p0' END, id) AS policy, arg_max((['C', 'P'])[id % 2 + 1], id) AS cls,
    arg_max(CASE WHEN id % 5 = 0 THEN 'validators' ELSE 'review' END, id) AS vb, arg_max(id % 7 > 0, id) AS good FROM fx_units GROUP BY media_id, id % 400) c
JOIN fx_units s ON s.media_id = c.media_id AND s.id % 400 = c.k WHERE brief <> 0 AND good""")
def _(t):
    st = t.units.selectExpr("concat(cast(media_id as string), '/', cast(id % 400 as string)) AS key", "id AS at", "id % 3 AS brief", "if(id % 2 = 0, 'p1', 'p0') AS policy", "map('full', if(id % 7 > 0, 'కమ', 'bad')) AS tiers",
                            "array('C', 'P')[int(id % 2)] AS cls", "if(id % 5 = 0, 'validators', 'review') AS verdict_by")
    s = t.units.selectExpr("media_id", "id", "concat(cast(media_id as string), '/', cast(id % 400 as string)) AS key")
    return rp.cached_lines(st, s, "p1", 1).select("media_id", "id", "brief", "cls")


@query("retry_plan", """SELECT media_id, id, CASE id % 3 WHEN 0 THEN 'again' WHEN 1 THEN 'each' ELSE 'skipped' END AS next, CASE id % 3 WHEN 0 THEN 'r1; s' WHEN 1 THEN 'r1; s; r2' ELSE 'r1; s; r2; r3' END AS why FROM fx_units WHERE id % 4 > 0""")
def _(t):
    a = t.units.selectExpr("media_id", "id", "explode(sequence(1, int(id % 3) + 1)) AS rung").selectExpr("media_id", "id", "rung", "id % 4 = 0 AS usable", "array(concat('r', cast(rung as string)), 's') AS reasons")
    return rp.retry_plan(a)


@query("schema_report", """SELECT media_id, path, problem, COUNT(*) AS n FROM (SELECT media_id, unnest(CASE id % 5 WHEN 0 THEN ['$'] WHEN 1 THEN ['$.error', '$.id'] WHEN 2 THEN ['$.class'] WHEN 3 THEN ['$.odd'] ELSE [] END) AS path,
  unnest(CASE id % 5 WHEN 0 THEN ['not an object'] WHEN 1 THEN ['missing', 'expected integer'] WHEN 2 THEN ['not one of the allowed values'] WHEN 3 THEN ['unexpected'] ELSE [] END) AS problem FROM fx_units) GROUP BY ALL""")
def _(t):
    x = t.units.selectExpr("media_id", """case id % 5 when 0 then '[1' when 1 then '{"id": true, "class": "C"}' when 2 then '{"id": 4, "class": "Z", "error": "none"}' when 3 then '{"id": 4.0, "class": "C", "error": "none", "odd": 1}'
      else '{"id": 4, "class": "C", "error": "x"}' end AS reply""")
    return rp.schema_report(x, {"id": ("integer", None), "class": ("string", ["C", "m", "P", "E"]), "error": ("string", None)}, allowed=["id", "class", "error"])
