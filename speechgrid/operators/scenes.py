"""Scenes and batching: bounded scenes, their context, lanes, length targets, wording picks, brief parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import following, next_seen, row_number, running_sum, scan, walk, with_neighbours
from ..functions.spans import bucket_of
from ..session import stage
from .timing import budget_ms

M = ["media_id"]
CHUNK = 600_000
# Prior ratio of units per syllable, lines before it is learned, window, band of fit, dense share.
K_PRIOR, K_MIN_LINES, K_MIN_SYLLABLES, K_WINDOW = 1.4, 3, 4, 400
BAND = (0.85, 1.10)
DENSE = 0.8
TIERS = ("fuller", "full", "concise", "very_concise")
# End of fixed values.


def number_units(units: DataFrame, by: list[str] = M, chunk: Column | None = None) -> DataFrame:
    """Units with ``seq``: 0-based place in onset order."""
    return scan(units, by, ["start_ms", "id"], bucket_of("start_ms", CHUNK) if chunk is None else chunk, __n=row_number()).withColumn(
        "seq", F.col("__n") - 1).drop("__n")


def scene_cut(units: DataFrame, by: list[str] = M, max_ms: int = 30_000, max_units: int = 6, pause_ms: int = 1_000) -> DataFrame:
    """Bounded scenes (by, scene, seq, n, start_ms, end_ms): at most ``max_ms`` and ``max_units`` lines, cut at the last change
    of speaker or pause in the second half, else at the limit; a longer single line is a scene; a tail within the limits is
    one. ``units`` carry ``seq`` (``number_units``).

    Every line works out, from the few after it, how long a scene starting there would be; the walk over those jumps picks
    the scenes."""
    look = {f"__u{k}": (F.struct("start_ms", "end_ms", "speaker"), k) for k in range(1, max_units + 1)}
    x = with_neighbours(units.select(*by, "seq", "speaker", "start_ms", "end_ms"), by, "seq", **look)
    x = x.withColumn("__r", F.filter(F.array(F.struct("start_ms", "end_ms", "speaker"), *look), lambda u: u.isNotNull()))
    x = x.withColumn("__fit", F.expr(
        f"coalesce(array_min(filter(transform(slice(__r, 1, {max_units}), (u, i) -> if(u.end_ms - start_ms > {max_ms}, i, null)), i -> i is not null)),"
        f" least(size(__r), {max_units}))"))
    cuts = (f"filter(if(__fit > 1, sequence(__fit - 1, 1, -1), array()), i -> not exists(sequence(i, __fit - 1), j -> "
            f"(__r[j].end_ms - start_ms) * 2 < {max_ms}) and (i + 1 >= size(__r) or get(__r, i + 1).speaker <> __r[i].speaker or "
            f"get(__r, i + 1).start_ms - __r[i].end_ms >= {pause_ms}))")
    x = x.withColumn("n", F.expr(f"cast(case when __fit = 0 then 1 when __fit = size(__r) and __fit < {max_units} then __fit "
                                 f"else coalesce(get({cuts}, 0) + 1, __fit) end as int)"))
    heads = walk(x.select(*by, "seq", "n"), by, "seq", "n", longest=max_units)
    lines = heads.withColumn("__s", F.explode(F.expr("sequence(seq, seq + n - 1)")))
    u = units.select(*by, F.col("seq").alias("__s"), "start_ms", "end_ms")
    g = lines.join(u, [*by, "__s"]).groupBy(*by, "seq").agg(F.count("*").cast("int").alias("n"), F.min_by("start_ms", "__s").alias("start_ms"),
                                                         F.max_by("end_ms", "__s").alias("end_ms"))
    return scan(g, by, ["seq"], F.expr("seq div 4096"), scene=row_number())


def scene_context(scenes: DataFrame, units: DataFrame, by: list[str] = M, before: int = 3, after: int = 2, span_ms: int = 60_000) -> DataFrame:
    """Context of each scene: up to ``before`` lines ending within ``span_ms`` before it, each with its chosen translation
    (NULL when it has none), and up to ``after`` lines starting within it after. ``units(by, seq, start_ms, end_ms, text,
    chosen)``."""
    want = F.concat(F.sequence(F.col("seq") - before, F.col("seq") - 1), F.sequence(F.col("seq") + F.col("n"), F.col("seq") + F.col("n") + after - 1))
    x = scenes.select(*by, "scene", F.col("seq").alias("__k"), F.col("start_ms").alias("__a"), F.col("end_ms").alias("__z"), F.explode(want).alias("seq"))
    j = x.join(units.select(*by, "seq", "start_ms", "end_ms", "text", "chosen"), [*by, "seq"])
    pre = (F.col("seq") < F.col("__k")) & (F.col("end_ms") >= F.col("__a") - span_ms)
    post = (F.col("seq") >= F.col("__k")) & (F.col("start_ms") <= F.col("__z") + span_ms)
    j = j.withColumn("__pre", pre).filter(pre | post)
    got = j.groupBy(*by, "scene").agg(
        F.array_sort(F.collect_list(F.when(F.col("__pre"), F.struct("seq", "text", "chosen")))).alias("b"),
        F.array_sort(F.collect_list(F.when(~F.col("__pre"), F.struct("seq", "text")))).alias("a"))
    x = scenes.select(*by, "scene").join(got, [*by, "scene"], "left")
    empty = "cast(array() as array<struct<text:string,chosen:string>>)"
    return x.select(*by, "scene", F.expr(f"coalesce(transform(b, x -> struct(x.text as text, x.chosen as chosen)), {empty})").alias("before"),
                    F.expr("coalesce(transform(a, x -> x.text), cast(array() as array<string>))").alias("after"))


def lanes(scenes: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), by: list[str] = M) -> DataFrame:
    """Scenes with a ``lane`` 0..2: contiguous, in proportion to the weights, each lane keeping a scene where it can."""
    if len(weights) != 3 or min(weights) <= 0:
        raise ValueError("three positive weights")
    n = scenes.groupBy(*by).agg(F.count("*").alias("__n"))
    x = scenes.join(n, by)
    c = F.col("__n")
    if len(set(weights)) == 1:
        e1, e2 = F.expr("__n div 3"), F.expr("2 * __n div 3")
    else:
        total = sum(weights)
        e1 = F.greatest(F.lit(1), F.least(F.floor(c * (weights[0] / total)), c - 2))
        e2 = F.greatest(e1 + 1, F.least(F.floor(c * ((weights[0] + weights[1]) / total)), c - 1))
    i = F.col("scene") - 1
    return x.withColumn("lane", F.when(c < 3, i).when(i < e1, 0).when(i < e2, 1).otherwise(2).cast("int")).drop("__n")


def length_ratio(lines: DataFrame, by: list[str] = ["media_id", "speaker"]) -> DataFrame:
    """Units of the translation per source syllable of each speaker: the median over the last 400 lines with at least four
    syllables; the prior until there are three. ``lines(by, start_ms, id, units, syllables)``."""
    x = lines.withColumn("__ok", F.col("syllables") >= K_MIN_SYLLABLES)
    x = scan(x, by, ["start_ms", "id"], bucket_of("start_ms", CHUNK), __r=running_sum(F.when(F.col("__ok"), 1).otherwise(0)))
    tot = x.groupBy(*by).agg(F.max("__r").alias("__n"))
    late = F.col("__ok") & (F.col("__r") > F.col("__n") - K_WINDOW)
    g = x.join(tot, by).groupBy(*by, "__n").agg(F.percentile(F.when(late, F.col("units") / F.col("syllables")), F.lit(0.5)).alias("__m"))
    return g.select(*by, F.when(F.col("__n") >= K_MIN_LINES, F.col("__m")).otherwise(K_PRIOR).alias("k"), F.col("__n").alias("n"))


def line_specs(lines: DataFrame) -> DataFrame:
    """Target units and tiers wanted per line. ``lines(…, start_ms, end_ms, speech_ms, rate, overhead, k, syllables)``."""
    x = lines.withColumns({"target_units": F.greatest(F.col("speech_ms") / 1000 - F.col("overhead"), F.lit(0.0)) * F.col("rate"),
                           "pred_full": F.col("k") * F.col("syllables")})
    dense = F.col("speech_ms") >= DENSE * (F.col("end_ms") - F.col("start_ms"))
    want = (F.when(F.col("pred_full") > BAND[1] * F.col("target_units"), F.array(F.lit("full"), F.lit("concise"), F.lit("very_concise")))
            .when((F.col("pred_full") < BAND[0] * F.col("target_units")) & dense, F.array(F.lit("full"), F.lit("fuller"))).otherwise(F.array(F.lit("full"))))
    return x.withColumn("want", want)


def absorbs(slots: DataFrame, pred: Column, speed_cap: float = 1.2) -> Column:
    """Whether a slot could take ``pred`` milliseconds within the speed cap: an approximation of placing it on the timeline,
    from the slot's own budget (``line_slots`` columns)."""
    return pred <= budget_ms() * speed_cap


def pick_tier(tiers: DataFrame, lines: DataFrame, key: list[str] = ["media_id", "id"]) -> DataFrame:
    """The wording to say: the fullest one predicted within the band; else the closest above if the slot absorbs it; else the
    closest below (above when nothing is below). An approved full wording is kept whatever its length.
    ``tiers(key, tier, pred_ms)``; ``lines(key, speech_ms, budget_ms, approved_full)`` -> (key, tier, fits)."""
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    x = tiers.join(lines, key)
    lo, hi, p = BAND[0] * F.col("speech_ms"), BAND[1] * F.col("speech_ms"), F.col("pred_ms")
    absorbed = p <= F.col("budget_ms") * 1.2
    g = x.groupBy(*key).agg(
        F.first("approved_full").alias("__ok"), F.min_by("tier", F.when((p >= lo) & (p <= hi), order)).alias("__in"),
        F.min_by(F.struct("tier", absorbed.alias("a")), F.when(p > hi, F.struct(p, order))).alias("__up"),
        F.max_by("tier", F.when(p < lo, F.struct(p, -order))).alias("__dn"),
        F.max(F.when(F.col("tier") == "full", ((p >= lo) & (p <= hi)) | absorbed)).alias("__ff"))
    up_fits = F.coalesce(F.col("__up.a"), F.lit(False))
    tier = (F.when(F.col("__ok"), "full").when(F.col("__in").isNotNull(), F.col("__in"))
            .when(up_fits | F.col("__dn").isNull(), F.col("__up.tier")).otherwise(F.col("__dn")))
    fits = F.when(F.col("__ok"), F.coalesce("__ff", F.lit(False))).otherwise(F.col("__in").isNotNull() | up_fits)
    return g.select(*key, tier.alias("tier"), fits.alias("fits"))


def fit_requests(lines: DataFrame) -> DataFrame:
    """What to ask for when a pick is outside the band. ``lines(…, tier, have ARRAY, pred_ms MAP tier->ms, units MAP,
    speech_ms, start_ms, end_ms, target_units, approved_full)`` adds want, source_tier and overflow; want is empty when
    nothing helps."""
    t = F.array(*[F.lit(v) for v in TIERS])
    x = lines.withColumns({"__t": t, "__p": F.array_position(t, F.col("tier")).cast("int")})
    over = F.element_at("pred_ms", F.col("tier")) > BAND[1] * F.col("speech_ms")
    dense = F.col("speech_ms") >= DENSE * (F.col("end_ms") - F.col("start_ms"))
    x = x.withColumn("__longer", F.expr("filter(slice(__t, 1, __p - 1), v -> array_contains(have, v))"))
    near = F.expr("get(__longer, size(__longer) - 1)")
    x = x.withColumn("__near", near)
    between = F.expr("slice(__t, cast(array_position(__t, __near) as int) + 1, greatest(__p - cast(array_position(__t, __near) as int) - 1, 0))")
    shorter = F.expr("filter(array('concise', 'very_concise'), v -> not array_contains(have, v))")
    none = F.expr("cast(array() as array<string>)")
    want = (F.when(F.col("approved_full"), none).when(over, shorter)
            .when(F.size("__longer") > 0, F.when(F.col("tier") == "full", F.array(F.lit("fuller"))).when(F.size(between) > 0, between).otherwise(F.array(F.col("tier"))))
            .when(~F.array_contains("have", "fuller") & dense, F.array(F.lit("fuller"))).otherwise(none))
    src = F.when(~over & (F.size("__longer") > 0) & (F.col("tier") != "full"), F.col("__near")).otherwise(F.col("tier"))
    x = x.withColumns({"want": want, "source_tier": src})
    return x.withColumn("overflow", F.element_at("units", F.col("source_tier")) - F.col("target_units")).drop("__t", "__p", "__longer", "__near")


def brief_parts(units: DataFrame, chunks: DataFrame, by: list[str] = M, words: int = 8_000) -> DataFrame:
    """Transcript rows packed in order into parts of at most ``words`` words: (by, chunk_no, words, part). A unit goes with the
    row it starts in (the first row when it starts before all). Rows with no words belong to no part.

    Where a part starting at a row would end is found by looking ahead on the running total; the walk picks the parts."""
    c = chunks.select(*by, "chunk_no", F.col("a_ms").alias("t"), F.lit(0).alias("__kind"), F.lit(None).cast("bigint").alias("w"))
    u = units.select(*by, F.lit(None).cast("bigint").alias("chunk_no"), F.col("start_ms").alias("t"), F.lit(1).alias("__kind"), F.col("n_words").cast("bigint").alias("w"))
    from ..functions.scan import last_seen
    x = scan(c.unionByName(u).withColumn("__tie", F.coalesce("chunk_no", F.col("w"))), by, ["t", "__kind", "__tie"], bucket_of("t", CHUNK), row=last_seen("chunk_no"))
    first = chunks.groupBy(*by).agg(F.min("chunk_no").alias("__first"))
    r = (x.filter("__kind = 1").join(first, by).groupBy(*by, F.coalesce("row", "__first").alias("chunk_no")).agg(F.sum("w").alias("words")).filter("words > 0"))
    r = stage(scan(stage(r), by, ["chunk_no"], F.expr("chunk_no div 4096"), seq=row_number(), cum=running_sum("words"))
              .withColumn("seq", F.col("seq") - 1))
    ends = r.select(*by, F.col("cum").alias("__v"), F.lit(1).alias("__k"), "seq", F.col("seq").alias("__stop"))
    asks = r.select(*by, (F.col("cum") - F.col("words") + words).alias("__v"), F.lit(2).alias("__k"), "seq", F.lit(None).cast("bigint").alias("__stop"))
    nxt = scan(ends.unionByName(asks), by, ["__v", "__k", "seq"], F.expr(f"__v div {10 * words}"), stop=next_seen("__stop"))
    n = r.groupBy(*by).agg(F.count("*").alias("__n"))
    jumps = (nxt.filter("__k = 2").join(n, by).select(*by, "seq", F.greatest(F.lit(1), F.coalesce("stop", "__n") - F.col("seq")).cast("int").alias("n")))
    size = max(256, words + 1)  # every row holds a word, so a part holds at most ``words`` rows
    heads = walk(jumps, by, "seq", "n", longest=size, size=size).select(*by, "seq", F.lit(1).alias("__h"))
    out = r.join(heads, [*by, "seq"], "left")
    out = scan(out, by, ["chunk_no"], F.expr("chunk_no div 4096"), part=running_sum(F.coalesce("__h", F.lit(0))))
    return out.select(*by, "chunk_no", "words", "part")
