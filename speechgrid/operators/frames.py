"""Frame tables: pauses of a take, squeezing, take checks, ducking spans and gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import bucket_of, point_join
from ..functions.scan import running_sum, scan
from .intervals import interval_subtract, interval_union

FRAME_MS = 10
_PART = 100  # frames of a recording whose gains are made together


def pauses(frames: DataFrame, key: list[str] = ["media_id", "take"], frame_ms: int = FRAME_MS, floor_db: float = -40.0,
           min_ms: int = 150) -> DataFrame:
    """Silent runs of each take: frames quieter than the 95th percentile by 40 dB, runs of at least ``min_ms`` (a run at
    either end counts however short); a take with no sound is one pause. ``frames(key, frame_no, value[, n])``: a row stands for
    ``n`` frames of one value from ``frame_no`` on (one, without the column), so equal neighbours travel as one row. A take is one
    spoken line, so its frames are few: one shuffle by take, and windows over it."""
    n = F.col("n") if "n" in frames.columns else F.lit(1).cast("bigint")
    take = Window.partitionBy(*key)
    x = frames.filter(n > 0).select(*key, "frame_no", "value", n.alias("__n")).withColumns({
        "__loud": F.percentile("value", F.lit(0.95), F.col("__n")).over(take), "__hi": F.max(F.col("frame_no") + F.col("__n") - 1).over(take)})
    quiet = F.when(F.col("__loud") <= 1e-6, True).otherwise(F.col("value") < F.col("__loud") * 10 ** (floor_db / 20))
    x = scan(x.withColumn("__q", quiet), key, ["frame_no"], __run=running_sum(F.when(F.col("__q"), 0).otherwise(1)))
    g = x.filter("__q").groupBy(*key, "__run", "__hi").agg(F.min("frame_no").alias("a"), F.max(F.col("frame_no") + F.col("__n") - 1).alias("b"))
    g = g.filter(((F.col("b") - F.col("a") + 1) * frame_ms >= min_ms) | (F.col("a") == 0) | (F.col("b") == F.col("__hi")))
    return g.select(*key, (F.col("a") * frame_ms).alias("start_ms"), ((F.col("b") + 1) * frame_ms).alias("end_ms"))


def internal(spans: DataFrame, totals: DataFrame, key: list[str] = ["media_id", "take"], frame_ms: int = FRAME_MS) -> DataFrame:
    """Pauses inside the take: not its leading or trailing silence. ``totals(key, total_ms)``."""
    return (spans.join(totals.select(*key, "total_ms"), key)
            .filter((F.col("start_ms") * 2 > frame_ms) & ((F.col("total_ms") - F.col("end_ms")) * 2 > frame_ms)).drop("total_ms"))


def voiced(spans: DataFrame, totals: DataFrame, key: list[str] = ["media_id", "take"]) -> DataFrame:
    """Where each take sounds: [0, total] less its pauses."""
    whole = totals.select(*key, F.lit(0).cast("bigint").alias("start_ms"), F.col("total_ms").alias("end_ms"))
    return interval_subtract(whole, spans, key)


def squeeze(takes: DataFrame, keep_ms: int = 120) -> DataFrame:
    """How a take plays in total / rate: pauses shorten first, to no less than ``keep_ms``, then speech speeds up.
    ``takes(…, total_ms, rate, pauses ARRAY<BIGINT lengths>)`` adds speech_rate and cuts (ms cut per pause, in order).

    When pauses alone are not enough the rate r solves total/r - sum(max(d/r - keep, 0)) = total/rate. With the pauses
    sorted longest first, the n longest are the ones still cut at r, and then r = (total - sum d) / (target - n keep); the
    right n is the one its own r agrees with."""
    t = takes.withColumns({"__d": F.expr("sort_array(transform(pauses, d -> cast(d as double)), false)"),
                           "__target": F.col("total_ms") / F.col("rate"),
                           "__spare": F.expr(f"aggregate(pauses, 0.0D, (a, d) -> a + greatest(d - {keep_ms}, 0))")})
    cand = (f"transform(sequence(0, size(__d)), n -> struct(n as n, (total_ms - aggregate(slice(__d, 1, n), 0.0D, (a, d) -> a + d)) / "
            f"(__target - n * {keep_ms}) as r))")
    agree = (f"filter({cand}, c -> c.r > 0 and (c.n = 0 or __d[c.n - 1] / c.r > {keep_ms} - 1e-9) and (c.n = size(__d) or __d[c.n] / c.r <= "
             f"{keep_ms} + 1e-9))[0].r")
    alone = F.col("total_ms") - F.col("__spare") <= F.col("__target") + 1e-9
    none = (F.col("rate") <= 1 + 1e-9) | (F.col("total_ms") <= 0)
    t = t.withColumn("speech_rate", F.when(none | alone, 1.0).otherwise(F.expr(agree)))
    cuts = F.when(none, F.expr("transform(pauses, d -> 0.0D)")).when(alone, F.expr(
        f"transform(pauses, d -> if(__spare > 0, (total_ms - __target) * greatest(d - {keep_ms}, 0) / __spare, 0.0D))")).otherwise(
        F.expr(f"transform(pauses, d -> greatest(d / speech_rate - {keep_ms}, 0.0D))"))
    return t.withColumn("cuts", cuts).drop("__d", "__target", "__spare")


def take_failures(takes: DataFrame, samples: DataFrame, key: list[str] = ["media_id", "take"], short: float = 0.6) -> DataFrame:
    """``takes(key, seconds, capped, estimate)`` with ``failure``: audio_empty, audio_nonfinite, audio_silent (peak at most
    1e-6), cap, short, or NULL. ``samples(key, value)``."""
    v = F.col("value").cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    g = samples.groupBy(*key).agg(F.count("*").alias("__n"), F.max(bad).alias("__bad"), F.max(F.when(~bad, F.abs(v))).alias("__peak"))
    x = takes.join(g, key, "left")
    f = (F.when(F.coalesce("__n", F.lit(0)) == 0, "audio_empty").when(F.col("__bad"), "audio_nonfinite")
         .when(F.col("__peak") <= 1e-6, "audio_silent").when(F.col("capped"), "cap").when(F.col("seconds") < short * F.col("estimate"), "short"))
    return x.withColumn("failure", f).drop("__n", "__bad", "__peak")


def pick_take(takes: DataFrame, line: list[str] = ["media_id", "id"], target: str = "target_s") -> DataFrame:
    """The take of each line to voice: least severe failure (none, short, cap; others rank with short), then nearest to the
    target by ratio, then first: (line, take)."""
    sev = F.when(F.col("failure").isNull(), 0).when(F.col("failure") == "cap", 2).otherwise(1)
    off = F.abs(F.log(F.greatest(F.col("seconds"), F.lit(1e-3)) / F.greatest(F.col(target), F.lit(1e-3))))
    return takes.groupBy(*line).agg(F.min_by("take", F.struct(sev, off, F.col("take"))).alias("take"))


def duck_spans(lines: DataFrame, speech: DataFrame, by: list[str] = ["media_id"], bridge_ms: int = 500, bare_gap_ms: int = 1_000,
               bare_min_ms: int = 1_500) -> DataFrame:
    """Spans to lower the background in: ``duck`` (lines and speech, bridged) and ``bare`` (speech with no line near)."""
    a, b = lines.select(*by, "start_ms", "end_ms"), speech.select(*by, "start_ms", "end_ms")
    duck = interval_union(a.unionByName(b), by, touch=False, bridge_ms=bridge_ms)
    near = a.select(*by, (F.col("start_ms") - bare_gap_ms).alias("start_ms"), (F.col("end_ms") + bare_gap_ms).alias("end_ms"))
    bare = interval_subtract(interval_union(b, by, touch=False, bridge_ms=bridge_ms), near, by, bare_min_ms - 1)
    return duck.withColumn("kind", F.lit("duck")).unionByName(bare.withColumn("kind", F.lit("bare")))


def gain_envelope(spans: DataFrame, durations: DataFrame, by: list[str] = ["media_id"], frame_ms: int = 100, attack_ms: int = 150,
                  release_ms: int = 400, duck_db: float = -6.0, bare_db: float = -12.0) -> DataFrame:
    """Background gain per frame (at its start): (by, frame_no, gain). -6 dB inside duck spans, -12 dB inside bare ones,
    raised-cosine ramps around both, the strongest where ramps meet; 0 dB elsewhere. Spans and recordings are dealt to parts of
    ``_PART`` frames, and frames are made where a part's spans have met: no frame is shuffled."""
    frame = lambda ms: F.ceil(ms / frame_ms).cast("bigint")
    x = spans.select(*by, "kind", "start_ms", "end_ms", F.greatest(F.lit(0).cast("bigint"), frame(F.col("start_ms") - attack_ms)).alias("__lo"),
                     frame(F.col("end_ms") + release_ms).alias("__hi"))
    none = F.lit(None)
    own = durations.select(*by, none.cast("string").alias("kind"), none.cast("bigint").alias("start_ms"), none.cast("bigint").alias("end_ms"),
                           F.lit(0).cast("bigint").alias("__lo"), F.expr(f"(duration_ms - 1) div {frame_ms}").alias("__hi"))
    x = own.unionByName(x).filter("__hi >= __lo").withColumn("__p", F.explode(F.expr(f"sequence(__lo div {_PART}, __hi div {_PART})")))
    kind = F.col("kind")
    g = x.groupBy(*by, "__p").agg(F.max(F.when(kind.isNull(), F.least("__hi", F.col("__p") * _PART + _PART - 1))).alias("__hi"),
                                  *[F.collect_list(F.when(kind == k, F.struct("start_ms", "end_ms"))).alias(k) for k in ("duck", "bare")])
    g = g.filter("__hi is not null").select(*by, "duck", "bare", F.explode(F.expr(f"sequence(__p * {_PART}, __hi)")).alias("frame_no"))
    t = F.col("frame_no") * frame_ms

    def ramp(s: Column) -> Column:
        a, z = s["start_ms"] - attack_ms, s["end_ms"] + release_ms
        return (F.when((t < a) | (t >= z), 0.0).when(t < s["start_ms"], 0.5 - 0.5 * F.cos(F.pi() * (t - a) / attack_ms)).when(t < s["end_ms"], 1.0)
                .otherwise(0.5 + 0.5 * F.cos(F.pi() * (t - s["end_ms"]) / release_ms)))

    d, b = (F.coalesce(F.array_max(F.transform(k, ramp)), F.lit(0.0)) for k in ("duck", "bare"))
    return g.select(*by, "frame_no", F.pow(F.lit(10.0), (d * duck_db + b * (bare_db - duck_db)) / 20).alias("gain"))


def bed_gain(lines: DataFrame, gains: DataFrame, vocals: DataFrame, by: list[str] = ["media_id"], clamp_db: float = 12.0) -> DataFrame:
    """Gain (dB) that keeps the background where it sat under the original voices: mean square of the new voices over the
    original vocals', clamped; 0 where either is unknown. ``lines(by, speaker, energy, samples)``, ``gains(by, speaker,
    gain_db)``, ``vocals(by, mean)``."""
    e = F.sum(F.pow(F.lit(10.0), F.coalesce("gain_db", F.lit(0.0)) / 10) * F.col("energy"))
    g = lines.join(gains.select(*by, "speaker", "gain_db"), [*by, "speaker"], "left").groupBy(*by).agg(e.alias("e"), F.sum("samples").alias("n"))
    x = g.join(vocals.select(*by, F.col("mean").alias("v")), by, "left")
    db = 10 * F.log10(F.col("e") / F.col("n") / F.col("v"))
    return x.select(*by, F.when((F.col("n") > 0) & (F.col("e") > 0) & (F.col("v") > 0), F.least(F.greatest(db, F.lit(-clamp_db)), F.lit(clamp_db)))
                    .otherwise(0.0).alias("gain_db"))


def speaker_gains(loudness: DataFrame, ref: float = -20.0, clamp_db: float = 6.0, silent: float = -69.0) -> DataFrame:
    """Each speaker's gain in dB from a measured loudness: -20 minus it, clamped; 0 when silent."""
    i = F.col("loudness")
    return loudness.withColumn("gain_db", F.when(i <= silent, 0.0).otherwise(F.least(F.greatest(ref - i, F.lit(-clamp_db)), F.lit(clamp_db))))
