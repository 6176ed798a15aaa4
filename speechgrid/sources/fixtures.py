"""Views derived from the supplied tables: the timed-speech inputs the registered queries run on.

``Tables`` builds each view lazily for one folder of parquet tables. ``SQL`` holds the same views as CTE text for the
comparison engine. Both are integer-only, so sums do not depend on order.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import running_sum, scan
from ..session import stage


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def tok(self) -> DataFrame:
        c = self.read("conversations")
        words = F.filter(F.split("text", "[ \\n\\t\\r]+"), lambda x: x != "")
        return c.select(F.col("conv_id").cast("bigint").alias("media_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.col("role").alias("speaker"), F.posexplode(words).alias("pos", "word"))

    @cached_property
    def words(self) -> DataFrame:
        """One row per word on the recording's clock. The running clock is carried turn by turn."""
        m = self.tok.withColumn("dur", F.expr("80L + 40 * length(word)")).withColumn("gap", F.expr(
            "(pos * 137 + turn * 59) % 400 + if(pos % 17 = 0, 900, 0) + if(pos % 41 = 40, 1200, 0)"))
        m = scan(m, ["media_id"], ["turn", "pos"], F.col("turn"), e=running_sum(F.col("gap") + F.col("dur")),
                 n=running_sum(F.lit(1).cast("bigint")))
        # Kept as a stored table, as a library keeps its transcripts: most queries read it several times.
        return stage(m.select("media_id", (F.col("n") - 1).alias("idx"), "turn", "pos", "speaker", "word",
                        (F.col("e") - F.col("dur")).cast("bigint").alias("start_ms"),
                        F.col("e").cast("bigint").alias("end_ms"),
                        F.expr("cast((pos * 37 + length(word) * 11 + turn * 7) % 100 as int)").alias("conf_pct")))

    @cached_property
    def turns(self) -> DataFrame:
        """Speaker turns; every third runs 1.2 s past its words, so crosstalk exists."""
        return (self.words.groupBy("media_id", "turn", "speaker")
                .agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
                .select("media_id", "turn", "speaker", F.expr("greatest(a - 50, 0)").alias("start_ms"),
                        F.expr("b + if(turn % 3 = 0, 1200, 50)").alias("end_ms")))

    @cached_property
    def ex(self) -> DataFrame:
        """Exclusive turns: the words' own span."""
        return (self.words.groupBy("media_id", "turn", "speaker")
                .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")))

    @cached_property
    def phrases(self) -> DataFrame:
        """Exclusive speech phrases: runs of nine words."""
        return (self.words.groupBy("media_id", "speaker", (F.col("turn") * 10000 + F.expr("pos div 9")).alias("phrase"))
                .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")))

    @cached_property
    def units(self) -> DataFrame:
        """Line-sized units: eight words of one turn. ``id`` is unique and ordered inside a recording."""
        return (self.words.groupBy("media_id", "speaker", (F.col("turn") * 10000 + F.expr("pos div 8")).alias("id"))
                .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
                     F.count("*").alias("n_words"), F.sum("conf_pct").cast("bigint").alias("conf_sum")))

    @cached_property
    def unit_text(self) -> DataFrame:
        """``units`` with their text and word array."""
        w = F.array_sort(F.collect_list(F.struct("pos", "word", "start_ms", "end_ms", "conf_pct")))
        return (self.words.groupBy("media_id", "speaker", (F.col("turn") * 10000 + F.expr("pos div 8")).alias("id"))
                .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), w.alias("words"))
                .withColumn("text", F.expr("array_join(transform(words, w -> w.word), ' ')")))

    @cached_property
    def durations(self) -> DataFrame:
        return self.words.groupBy("media_id").agg((F.max("end_ms") + 500).alias("duration_ms"))

    @cached_property
    def trace(self) -> DataFrame:
        """Processing events; ``media_id`` groups runs."""
        e = self.read("events")
        return e.select(
            "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("t_ms"),
            F.expr("concat('r', cast(user_id as string))").alias("run_id"),
            F.expr("cast(user_id % 20 as bigint)").alias("media_id"),
            F.expr("""case event_type when 'view' then 'unit' when 'click' then 'claude' when 'purchase' then
                      'stage_timing' when 'signup' then 'gpu_work' else 'skipped' end""").alias("event"),
            F.expr("cast(round(value * 1000) as bigint)").alias("wall_ms"),
            F.expr("cast(get_json_object(props, '$.k') as int)").alias("k"))

    @cached_property
    def plans(self) -> DataFrame:
        """Placed lines: a start offset and a speaking rate per unit, with carried and own overdraft."""
        return self.units.select(
            "media_id", "id", "speaker", F.col("start_ms").alias("src_start_ms"), F.col("end_ms").alias("src_end_ms"),
            F.expr("greatest(start_ms + (id * 61) % 500 - 100, 0)").alias("start_ms"),
            F.expr("greatest(start_ms + (id * 61) % 500 - 100, 0) + (end_ms - start_ms) * 100 div (100 + (id * 13) % 21)")
            .alias("end_ms"),
            F.expr("100 + (id * 13) % 21").alias("rate_pct"),
            F.expr("if(id % 7 = 0, (id * 17) % 900, 0)").alias("overdraft_ms"),
            F.expr("if(id % 11 = 0, (id * 23) % 700, 0)").alias("freeze_ms"),
            F.expr("element_at(array('full', 'concise', 'very_concise'), cast(id % 3 as int) + 1)").alias("said"))

    @cached_property
    def frames(self) -> DataFrame:
        """One value per 100 ms frame in which a word starts."""
        return (self.words.groupBy("media_id", F.expr("start_ms div 100").alias("frame_no"))
                .agg(F.max("conf_pct").cast("bigint").alias("value")))

    @cached_property
    def jobs(self) -> DataFrame:
        """One job per user with a status, a queue time, bytes and a media length."""
        return (self.trace.groupBy(F.expr("cast(substr(run_id, 2) as bigint)").alias("job_id"))
                .agg(F.min("t_ms").alias("queued_ms"), F.max("t_ms").alias("updated_ms"),
                     F.sum("wall_ms").alias("media_ms"), F.sum(F.col("k").cast("bigint")).alias("kb"),
                     F.count("*").alias("events"))
                .withColumn("status", F.expr("element_at(array('queued', 'done', 'running', 'paused'), "
                                             "cast(job_id % 4 as int) + 1)")))

    @cached_property
    def lines(self) -> DataFrame:
        """Source and reply text of consecutive turns: the user's turn and the answer after it."""
        c = self.read("conversations").select(F.col("conv_id").cast("bigint").alias("media_id"),
                                              F.col("turn").cast("bigint").alias("id"), "role", "text")
        nxt = c.select("media_id", (F.col("id") - 1).alias("id"), F.col("role").alias("role2"), F.col("text").alias("spoken"))
        return (c.filter("role = 'user'").join(nxt.filter("role2 = 'assistant'"), ["media_id", "id"])
                .select("media_id", "id", F.col("text").alias("source"), "spoken"))


SQL = {
    "fx_tok": r"""SELECT CAST(conv_id AS BIGINT) AS media_id, CAST(turn AS BIGINT) AS turn, role AS speaker,
  unnest(range(len(w))) AS pos, unnest(w) AS word
FROM (SELECT *, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') AS w FROM conversations)""",
    "fx_words": """SELECT media_id, ROW_NUMBER() OVER (PARTITION BY media_id ORDER BY turn, pos) - 1 AS idx, turn, pos, speaker,
  word, CAST(e - dur AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms,
  CAST((pos*37 + length(word)*11 + turn*7) % 100 AS INT) AS conf_pct
FROM (SELECT *, SUM(gap + dur) OVER (PARTITION BY media_id ORDER BY turn, pos ROWS UNBOUNDED PRECEDING) AS e
  FROM (SELECT *, 80 + 40*length(word) AS dur, (pos*137 + turn*59) % 400 + CASE WHEN pos % 17 = 0 THEN 900 ELSE 0 END
    + CASE WHEN pos % 41 = 40 THEN 1200 ELSE 0 END AS gap FROM fx_tok))""",
    "fx_turns": """SELECT media_id, turn, speaker, CAST(GREATEST(MIN(start_ms) - 50, 0) AS BIGINT) AS start_ms,
  CAST(MAX(end_ms) + CASE WHEN turn % 3 = 0 THEN 1200 ELSE 50 END AS BIGINT) AS end_ms
FROM fx_words GROUP BY media_id, turn, speaker""",
    "fx_ex": """SELECT media_id, turn, speaker, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms
FROM fx_words GROUP BY media_id, turn, speaker""",
    "fx_phrases": """SELECT media_id, speaker, turn * 10000 + pos // 9 AS phrase, MIN(start_ms) AS start_ms,
  MAX(end_ms) AS end_ms FROM fx_words GROUP BY ALL""",
    "fx_units": """SELECT media_id, speaker, turn * 10000 + pos // 8 AS id, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms,
  COUNT(*) AS n_words, CAST(SUM(conf_pct) AS BIGINT) AS conf_sum FROM fx_words GROUP BY media_id, speaker, turn * 10000 + pos // 8""",
    "fx_unit_text": """SELECT media_id, speaker, turn * 10000 + pos // 8 AS id, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms,
  string_agg(word, ' ' ORDER BY pos) AS text FROM fx_words GROUP BY media_id, speaker, turn * 10000 + pos // 8""",
    "fx_durations": "SELECT media_id, MAX(end_ms) + 500 AS duration_ms FROM fx_words GROUP BY media_id",
    "fx_trace": """SELECT event_id, epoch_us(ts) // 1000 AS t_ms, concat('r', CAST(user_id AS VARCHAR)) AS run_id,
  CAST(user_id % 20 AS BIGINT) AS media_id,
  CASE event_type WHEN 'view' THEN 'unit' WHEN 'click' THEN 'claude' WHEN 'purchase' THEN 'stage_timing'
    WHEN 'signup' THEN 'gpu_work' ELSE 'skipped' END AS event,
  CAST(round(value * 1000) AS BIGINT) AS wall_ms, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "fx_plans": """SELECT media_id, id, speaker, start_ms AS src_start_ms, end_ms AS src_end_ms,
  GREATEST(start_ms + (id*61) % 500 - 100, 0) AS start_ms,
  GREATEST(start_ms + (id*61) % 500 - 100, 0) + (end_ms - start_ms) * 100 // (100 + (id*13) % 21) AS end_ms,
  100 + (id*13) % 21 AS rate_pct, CASE WHEN id % 7 = 0 THEN (id*17) % 900 ELSE 0 END AS overdraft_ms,
  CASE WHEN id % 11 = 0 THEN (id*23) % 700 ELSE 0 END AS freeze_ms,
  CASE id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'concise' ELSE 'very_concise' END AS said FROM fx_units""",
    "fx_frames": """SELECT media_id, start_ms // 100 AS frame_no, CAST(MAX(conf_pct) AS BIGINT) AS value
FROM fx_words GROUP BY media_id, start_ms // 100""",
    "fx_jobs": """SELECT CAST(substr(run_id, 2) AS BIGINT) AS job_id, MIN(t_ms) AS queued_ms, MAX(t_ms) AS updated_ms,
  CAST(SUM(wall_ms) AS BIGINT) AS media_ms, CAST(SUM(k) AS BIGINT) AS kb, COUNT(*) AS events,
  CASE CAST(substr(run_id, 2) AS BIGINT) % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'done' WHEN 2 THEN 'running' ELSE 'paused' END AS status
FROM fx_trace GROUP BY run_id""",
    "fx_lines": """SELECT CAST(a.conv_id AS BIGINT) AS media_id, CAST(a.turn AS BIGINT) AS id, a.text AS source, b.text AS spoken
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with every view it names (directly or through another) as a CTE. ``extra`` adds views of its own."""
    views = {**SQL, **extra}
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in views and name not in need:
                visit(views[name])
                if name not in need:
                    need.append(name)

    visit(body)
    body = body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({views[n]})" for n in need)
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"
