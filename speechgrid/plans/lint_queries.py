"""Key terms and lint flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lint
from .registry import query
from .text_queries import AKSHARA, TE_DUCK, TE_SPARK


@query("key_terms")
def _(t):
    return lint.key_terms(t.unit_text.select("media_id", "id", "text"), "text").select("media_id", "id", "terms")


@query("lint_lines")
def _(t):
    x = t.unit_text.withColumn("spoken", F.concat_ws(" ", F.expr(TE_SPARK), F.lit("చేయండి"))).withColumn("english", F.expr(
        "transform(slice(words, 1, 4), (w, i) -> struct(int(i) as i, regexp_replace(w.word, '[^A-Za-z]', '') as en))"))
    return lint.lint_lines(x.select("media_id", "id", F.col("text").alias("source"), "spoken", "english"))


@query("echo_flag", """WITH w AS (SELECT media_id, id, start_ms, list_transform(list_filter(regexp_extract_all(text, '([A-Za-zÀ-ÖØ-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ''’-]*|\\d+(?:[.,:]\\d+)*|\\S)', 1), lambda t: regexp_matches(t, '^[A-Za-zÀ-ÖØ-öø-ɏ0-9]')), lambda t: lower(t)) AS ws FROM fx_unit_text),
g AS (SELECT media_id, id, start_ms, len(ws) AS n, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM w),
p AS (SELECT *, LAG(g) OVER z AS g1, LAG(g, 2) OVER z AS g2 FROM g WINDOW z AS (PARTITION BY media_id ORDER BY start_ms, id))
SELECT media_id, id, n >= 4 AND len(g) > 0 AND (COALESCE(len(list_intersect(g, g1))::DOUBLE / len(g) > 0.6, false) OR COALESCE(len(list_intersect(g, g2))::DOUBLE / len(g) > 0.6, false)) AS echo FROM p""")
def _(t):
    x = t.unit_text.select("media_id", "id", "start_ms", F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(" of "), F.col("media_id").cast("string"), F.lit(" is "), (F.col("id") * 3).cast("string")).alias("source"),
                           F.col("text").alias("spoken"))
    return lint.echo_flag(x).select("media_id", "id", "echo")


@query("length_flag", f"""SELECT media_id, id, CASE WHEN {AKSHARA} > 2 * tgt THEN 'too long' WHEN {AKSHARA} < 0.4 * tgt THEN 'too short' END AS length_flag
FROM (SELECT media_id, id, regexp_replace({TE_DUCK}, '[0-9]', '', 'g') AS te, 5.0 + id % 60 AS tgt FROM fx_unit_text)""")
def _(t):
    x = t.unit_text.select("media_id", "id", F.regexp_replace(F.expr(TE_SPARK), "[0-9]", "").alias("spoken"), F.expr("5.0D + id % 60").alias("target_units"))
    return lint.length_flag(x).select("media_id", "id", "length_flag")
