"""Subtitle cues: row layout, pieces, source and target cues, shaping and the merged track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import following, scan
from ..functions.spans import bucket_of
from .intervals import sweep_merge

ROW, MIN_MS = 42, 700
CHUNK = 600_000


def _fits(ws: str) -> str:
    """SQL: the words (structs with width ``w``) fit one row, are one word, or split into two rows that fit."""
    total = f"aggregate({ws}, 0D, (a, x) -> a + x.w) + size({ws}) - 1"
    return (f"(size({ws}) = 1 or {total} <= {ROW} or exists(sequence(1, greatest(size({ws}) - 1, 1)), k -> "
            f"aggregate(slice({ws}, 1, k), 0D, (a, x) -> a + x.w) + k - 1 <= {ROW} and "
            f"aggregate(slice({ws}, k + 1, size({ws})), 0D, (a, x) -> a + x.w) + size({ws}) - k - 1 <= {ROW}))")


def _layout(ws: str) -> str:
    """SQL: the rows joined by a newline; NULL when no break fits."""
    total = f"(aggregate({ws}, 0D, (a, x) -> a + x.w) + size({ws}) - 1)"
    head = f"aggregate(slice({ws}, 1, k), 0D, (a, x) -> a + x.w) + k - 1"
    tail = f"aggregate(slice({ws}, k + 1, size({ws})), 0D, (a, x) -> a + x.w) + size({ws}) - k - 1"
    best = (f"array_min(filter(transform(sequence(1, greatest(size({ws}) - 1, 1)), k -> if({head} <= {ROW} and {tail} <= {ROW}, "
            f"struct(abs({head} - {total} / 2) as d, k as k), null)), x -> x is not null)).k")
    text = f"transform({ws}, x -> x.t)"
    return (f"case when size({ws}) = 0 then null when {total} <= {ROW} or size({ws}) = 1 then array_join({text}, ' ') else "
            f"get(transform(array({best}), k -> concat(array_join(slice({text}, 1, k), ' '), '\n', array_join(slice({text}, k + 1, size({ws})), ' '))), 0) end")


def layout_rows(lines: DataFrame, words: str = "words", widths: Column | None = None) -> DataFrame:
    """Lines with ``rows``: one row when it fits 42, else two split at the space nearest the middle where both fit, else NULL.
    ``words`` is an ARRAY<STRING>; ``widths`` an ARRAY<DOUBLE> (characters by default)."""
    w = F.transform(words, lambda x: F.length(x).cast("double")) if widths is None else widths
    x = lines.withColumn("__ws", F.zip_with(words, w, lambda t, v: F.struct(t.alias("t"), v.alias("w"))))
    return x.withColumn("rows", F.expr(_layout("__ws"))).drop("__ws")


def _pieces(ws: str) -> str:
    """SQL: consecutive pieces, each with as many words as fit two rows."""
    grown = "concat(p, array(w))"
    return (f"aggregate(slice({ws}, 2, size({ws})), array(slice({ws}, 1, 1)), (ps, w) -> get(transform(array(element_at(ps, -1)), p -> "
            f"get(transform(array({grown}), g -> if({_fits('g')}, concat(slice(ps, 1, size(ps) - 1), array(g)), concat(ps, array(array(w))))), 0)), 0))")


def cue_pieces(lines: DataFrame, words: str = "ws") -> DataFrame:
    """Lines exploded to pieces of at most two rows: adds ``piece`` (0-based), ``part`` (its words) and ``text`` (its rows).
    ``words`` is an ARRAY<STRUCT<t STRING, w DOUBLE, …>>. One line has few words, so the greedy fold is short."""
    x = lines.filter(F.size(words) > 0).select("*", F.posexplode(F.expr(_pieces(words))).alias("piece", "part"))
    plain = "array_join(transform(part, x -> x.t), ' ')"
    return x.withColumn("text", F.expr(f"coalesce({_layout('part')}, {plain})"))


def source_cues(units: DataFrame, by: list[str] = ["media_id"], offset_ms: int = 0) -> DataFrame:
    """Cues of the source: each unit's pieces over their own words' times. ``units(by, id, speaker, words ARRAY<STRUCT<word,
    start_ms, end_ms>>)``."""
    ws = F.expr("transform(filter(words, x -> trim(x.word) <> ''), x -> struct(x.word as t, double(length(x.word)) as w, x.start_ms as a, x.end_ms as z))")
    p = cue_pieces(units.select(*by, "id", "speaker", ws.alias("ws")))
    return p.select(*by, "id", "speaker", "piece", (F.expr("part[0].a") + offset_ms).alias("start_ms"),
                    (F.expr("element_at(part, -1).z") + offset_ms).alias("end_ms"), "text")


def target_cues(lines: DataFrame, width, by: list[str] = ["media_id"], offset_ms: int = 0) -> DataFrame:
    """Cues of the translation: the line's span split by each piece's share of units. ``width`` maps a word Column to its
    width; a line whose words have no width is shared by characters. Edges are rounded to milliseconds on the running share,
    so pieces meet. ``lines(by, id, speaker, start_ms, end_ms, spoken)``."""
    words = F.filter(F.split("spoken", "\\s+"), lambda x: x != "")
    ws = F.transform(words, lambda t: F.struct(t.alias("t"), width(t).cast("double").alias("w")))
    p = cue_pieces(lines.select(*by, "id", "speaker", "start_ms", "end_ms", ws.alias("ws")))
    p = p.withColumns({"__u": F.expr("aggregate(part, 0D, (a, x) -> a + x.w)"), "__c": F.expr("double(length(array_join(transform(part, x -> x.t), ' ')))")})
    g = p.groupBy(*by, "id", "speaker", "start_ms", "end_ms").agg(F.array_sort(F.collect_list(F.struct("piece", "text", "__u", "__c"))).alias("ps"))
    g = g.withColumn("ps", F.expr("if(aggregate(ps, 0D, (a, x) -> a + x.__u) > 0, transform(ps, x -> struct(x.piece, x.text, x.__u as k)), "
                                  "transform(ps, x -> struct(x.piece, x.text, x.__c as k)))"))
    g = g.withColumn("__tot", F.expr("aggregate(ps, 0D, (a, x) -> a + x.k)"))
    x = g.select(*by, "id", "speaker", "start_ms", "end_ms", "__tot", F.explode(F.expr(
        "transform(ps, (x, i) -> struct(x.piece as piece, x.text as text, aggregate(slice(ps, 1, i), 0D, (a, y) -> a + y.k) as lo, "
        "aggregate(slice(ps, 1, i + 1), 0D, (a, y) -> a + y.k) as hi))")).alias("p"))

    def edge(c: str) -> Column:
        return (F.col("start_ms") + F.round((F.col("end_ms") - F.col("start_ms")) * F.col(f"p.{c}") / F.col("__tot")).cast("bigint")) + offset_ms
    return x.select(*by, "id", "speaker", "p.piece", edge("lo").alias("start_ms"), edge("hi").alias("end_ms"), "p.text")


def shape_cues(cues: DataFrame, by: list[str] = ["media_id"], stop_ms: int | str | None = None, floor_ms: int | str | None = None) -> DataFrame:
    """Cues that last at least 0.7 s where the next later start allows; none before ``floor_ms`` or past ``stop_ms``. Both are times, or
    columns of the cues that are NULL where a recording has no such bound."""
    stop, floor = (F.col(v) if isinstance(v, str) else None if v is None else F.lit(v) for v in (stop_ms, floor_ms))
    x = cues
    if floor is not None:
        x = x.filter(floor.isNull() | (F.col("end_ms") > floor)).withColumn("start_ms", F.greatest(F.col("start_ms"), floor))  # NULL counts as none
    starts = scan(x.select(*by, "start_ms").distinct(), by, ["start_ms"], bucket_of("start_ms", CHUNK), __next=following("start_ms"))
    x = x.join(starts, [*by, "start_ms"])
    least = F.col("start_ms") + MIN_MS
    end = F.when(F.col("end_ms") - F.col("start_ms") < MIN_MS, F.greatest(F.col("end_ms"), F.coalesce(F.least(least, F.col("__next")), least))).otherwise(F.col("end_ms"))
    if stop is not None:
        end = F.least(end, stop)
    return x.withColumn("end_ms", end).filter("end_ms > start_ms").select(*cues.columns)


def subtitle_track(cues: DataFrame, by: list[str] = ["media_id"], stop_ms: int | None = None) -> DataFrame:
    """One row per shown sample: (by, start_ms, duration_ms, text)."""
    m = sweep_merge(shape_cues(cues, by, stop_ms, 0), by)
    return m.select(*by, "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "text")
