"""Line timing: slots and budgets, closed-form fits, line and corpus KPIs, plan statistics, guards, voice pace."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pace as model
from ..functions.quantiles import quantiles
from ..functions.scan import following, prev, running_max, scan
from ..functions.spans import bucket_of, overlap_join, point_join
from ..session import stage
from .intervals import interval_length, interval_union, rolling_load, shared_length

cloudpickle.register_pickle_by_value(model)

CHUNK = 600_000
M = ["media_id"]


def _chunk(col: str = "start_ms") -> Column:
    return bucket_of(col, CHUNK)


def line_slots(units: DataFrame, by: list[str] = M) -> DataFrame:
    """Slots in onset order (start, id): next_start_ms, prev_end_ms (latest end among earlier lines), overlaps_prev (another
    speaker's line was still running), resume_ms (first later onset at or after this line's end; NULL if none)."""
    x = scan(units, by, ["start_ms", "id"], _chunk(), next_start_ms=following("start_ms"), prev_end_ms=running_max("end_ms"),
             __ps=prev("speaker"), __pe=prev("end_ms"))
    x = x.withColumn("overlaps_prev", F.coalesce((F.col("__ps") != F.col("speaker")) & (F.col("start_ms") < F.col("__pe")),
                                                 F.lit(False))).drop("__ps", "__pe")
    # First onset at or after a line's end: merge onsets and ends in time order and look ahead.
    on = units.select(*by, F.col("start_ms").alias("__t"), F.lit(1).alias("__kind"), F.col("id").alias("__id"),
                      F.col("start_ms").alias("__on"))
    ends = units.select(*by, F.col("end_ms").alias("__t"), F.lit(0).alias("__kind"), F.col("id").alias("__id"),
                        F.lit(None).cast("bigint").alias("__on"))
    from ..functions.scan import next_seen
    ahead = scan(on.unionByName(ends), by, ["__t", "__kind", "__id"], bucket_of("__t", CHUNK), resume_ms=next_seen("__on"))
    ahead = ahead.filter("__kind = 0").select(*by, F.col("__id").alias("id"), "resume_ms")
    return x.join(ahead, [*by, "id"], "left")


def slot_targets(slots: DataFrame, pace: str | None = None, guard_ms: int = 150, borrow_ms: int = 500, speed_cap: float = 1.2,
                 ceiling: float | None = None) -> DataFrame:
    """target_ms (span plus a small borrow of the silence after it), lag_limit_ms and rate_ceiling of each slot."""
    gap = F.col("next_start_ms") - F.col("end_ms")
    span = F.col("end_ms") - F.col("start_ms")
    borrow = F.when(gap.isNull(), F.lit(borrow_ms)).otherwise(F.least(F.greatest(gap - guard_ms, F.lit(0)), F.lit(borrow_ms)))
    calm = F.coalesce(gap >= 1_000, F.lit(True)) & (span <= 5_000)
    if pace is None or ceiling is None:
        cap = F.lit(speed_cap)
    else:
        p = F.col(pace)
        cap = F.when(p > 0, F.greatest(F.lit(1.0), F.least(F.lit(speed_cap), F.lit(ceiling) / p))).otherwise(F.lit(speed_cap))
    return slots.withColumns({"target_ms": span + borrow, "lag_limit_ms": F.when(calm, 1_000).otherwise(600).cast("bigint"),
                              "rate_ceiling": cap})


def budget_ms(guard_ms: int = 150, borrow_max_ms: int = 800) -> Column:
    """Span plus the silence a line may borrow."""
    gap = F.greatest(F.col("next_start_ms") - F.col("end_ms"), F.lit(0))
    borrow = F.when(F.col("next_start_ms").isNull(), F.lit(borrow_max_ms)).otherwise(
        F.least(F.greatest(gap - guard_ms, F.lit(0)), F.lit(borrow_max_ms)))
    return F.col("end_ms") - F.col("start_ms") + borrow


def slot_budget(slots: DataFrame, dur: str = "dur_ms", pace: str = "pace", fill: float = 0.95, threshold: float = 0.05) -> DataFrame:
    """budget_ms, target_units and whether a take of ``dur`` must be condensed."""
    x = slots.withColumn("budget_ms", budget_ms())
    return x.withColumns({"target_units": F.col("budget_ms") / 1000 * F.col(pace) * fill,
                          "condense": F.col(dur) > F.col("budget_ms") * (1 + threshold) + 1e-6})


def fit_lines(slots: DataFrame, dur: str = "dur_ms", by: list[str] = M, speed_cap: float = 1.25, min_video_rate: float = 0.75,
              rates: list[float] | None = None, max_freeze_ms: int = 3_000, added_ms: int = 12_000,
              overdraft: bool = False) -> DataFrame:
    """Closed-form fit of a take into its slot: speed up to ``speed_cap``, then slow the video (to one of ``rates`` when
    given), then freeze; what is left means condensing to ``condense_ratio`` or, with ``overdraft``, one longer freeze.
    ``over_window`` audits the rolling minute: more than ``added_ms`` of added time ends in (end - 60 s, end]."""
    x = slots.withColumn("budget_ms", budget_ms())
    d, b = F.col(dur).cast("double"), F.col("budget_ms").cast("double")
    x = x.withColumn("audio_rate", F.when(d <= b, 1.0).otherwise(F.least(d / b, F.lit(speed_cap))))
    x = x.withColumn("wall_ms", d / F.col("audio_rate"))
    over = F.greatest(F.col("wall_ms") - b, F.lit(0.0))
    over = F.when(over <= 1e-3, 0.0).otherwise(over)
    need = F.greatest(b / F.col("wall_ms"), F.lit(min_video_rate))
    if rates is not None:
        r = F.array_sort(F.array(*[F.lit(float(v)) for v in rates]))
        need = F.get(F.filter(r, lambda v: (v >= need - 1e-6) & (v < 1.0)), F.lit(0))
    x = x.withColumns({"__over": over, "video_rate": F.when((over > 0) & need.isNotNull() & (need < 1 - 1e-6), need)})
    gained = F.coalesce(b / F.col("video_rate") - b, F.lit(0.0))
    left = F.greatest(F.col("__over") - gained, F.lit(0.0))
    left = F.when(left <= 1e-3, 0.0).otherwise(left)
    freeze = left if overdraft else F.least(left, F.lit(float(max_freeze_ms)))
    x = x.withColumns({"slow_ms": gained, "freeze_ms": freeze,
                       "condense": F.lit(False) if overdraft else left > max_freeze_ms + 1e-3,
                       "overdraft_ms": F.greatest(left - max_freeze_ms, F.lit(0.0)) if overdraft else F.lit(0.0)})
    x = x.withColumn("condense_ratio", F.when(F.col("condense"), b * speed_cap / d * 0.97).otherwise(1.0)).drop("__over")
    # The audit of the rolling minute, in whole milliseconds at each slot's end.
    ev = x.filter(~F.col("condense")).select(*by, "id", (F.col("start_ms") + F.col("budget_ms")).alias("t"),
                                             F.round(F.col("slow_ms") + F.col("freeze_ms") - F.col("overdraft_ms")).cast("bigint").alias("v"))
    own = bucket_of("t", 60_000)
    ev = ev.withColumn("__own", own).withColumn("__b", F.explode(F.array("__own", F.col("__own") + 1)))
    w = Window.partitionBy(*by, "__b").orderBy("t").rangeBetween(-59_999, 0)
    load = (ev.withColumn("load_ms", F.sum("v").over(w)).filter(F.col("__b") == F.col("__own")).select(*by, "id", "load_ms"))
    x = x.join(load, [*by, "id"], "left")
    return x.withColumn("over_window", F.coalesce(F.col("load_ms") > added_ms, F.lit(False)))


def line_metrics(lines: DataFrame, speech: DataFrame, voiced: DataFrame, key: list[str] = ["media_id", "id"]) -> DataFrame:
    """Per line: end_error_ms (last voiced moment minus the end of its last speech) and overlap (voiced against speech,
    intersection over union); NULL when either is empty. ``speech`` and ``voiced`` are span tables keyed by line."""
    kw = {"bucket_ms": None}
    s = interval_union(speech, key, **kw).groupBy(*key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"),
                                                            F.max("end_ms").alias("__se"))
    v = interval_union(voiced, key, **kw).groupBy(*key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("voiced_ms"),
                                                            F.max("end_ms").alias("__ve"))
    both = shared_length(speech, voiced, key, **kw)
    x = lines.join(s, key, "left").join(v, key, "left").join(both, key, "left").na.fill(0, ["shared_ms"])
    known = F.col("speech_ms").isNotNull() & F.col("voiced_ms").isNotNull()
    return x.withColumns({
        "end_error_ms": F.when(known, F.col("__ve") - F.col("__se")),
        "overlap": F.when(known, F.col("shared_ms") / (F.col("speech_ms") + F.col("voiced_ms") - F.col("shared_ms")))}
    ).drop("__se", "__ve")


def speech_metrics(lines: DataFrame, speech: DataFrame, voiced: DataFrame, by: list[str] = M,
                   anchors: DataFrame | None = None, long_ms: int = 8_000, early_ms: int = 1_000) -> DataFrame:
    """Corpus KPIs per ``by``: end error p10/p50/p90, share ending early, long-line median, mean overlap, silent seconds
    per minute of speech (unions over all lines, skipped ones included) and anchor onset error."""
    m = stage(line_metrics(lines, speech, voiced, [*by, "id"]).select(*by, "start_ms", "end_ms", "end_error_ms", "overlap"))
    e = F.col("end_error_ms")
    is_long = F.col("end_ms") - F.col("start_ms") > long_ms
    places = quantiles(m, by, {"all": (e, {"end_error_p10": 0.1, "end_error_p50": 0.5, "end_error_p90": 0.9}), "long": (F.when(is_long, e), {"long_end_error_p50": 0.5})})
    agg = m.groupBy(*by).agg(
        F.count(e).alias("speech_lines"), F.avg(F.when(e.isNotNull(), F.when(e < -early_ms, 1.0).otherwise(0.0))).alias("end_early_share"),
        F.count(F.when(is_long, e)).alias("long_lines"), F.avg("overlap").alias("overlap_mean")).join(places, by, "left")
    heard = interval_length(speech, by).withColumnRenamed("length_ms", "heard_ms")
    both = shared_length(speech, voiced, by)
    x = agg.join(heard, by, "left").join(both, by, "left").na.fill(0, ["shared_ms"])
    x = x.withColumn("silent_s_per_min", F.when(F.col("heard_ms") > 0, (F.col("heard_ms") - F.col("shared_ms")) * 60.0 / F.col("heard_ms")))
    if anchors is not None:
        a = F.abs("error_ms")
        x = (x.join(anchors.groupBy(*by).agg(F.count("*").alias("anchors")), by, "left")
             .join(quantiles(anchors, by, {"error": (a, {"anchor_err_p50": 0.5, "anchor_err_p95": 0.95})}), by, "left").na.fill(0, ["anchors"]))
    return x.drop("heard_ms", "shared_ms")


def rate_steps(lines: DataFrame, by: list[str] = M, rate: str = "rate_pct") -> DataFrame:
    """Lines with ``step``: the change of rate since that speaker's line before (NULL for the first)."""
    x = scan(lines, [*by, "speaker"], ["start_ms", "id"], _chunk(), __r=prev(rate))
    return x.withColumn("step", F.abs(F.col(rate) - F.col("__r"))).drop("__r")


def latest_units(trace: DataFrame, key: list[str] = ["media_id", "id"]) -> DataFrame:
    """The lines of a trace as finally voiced: the latest ``unit`` event per id with the fields a later ``rephrase`` that
    replaced it carries (rate_pct, said, freeze_ms, voiced), where they are not NULL."""
    cols = ["speaker", "start_ms", "end_ms", "lag_ms", "rate_pct", "said", "freeze_ms"]
    over = ["said", "freeze_ms"]
    u = trace.filter("event = 'unit'").groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct("t_ms", "event_id")).alias("u"))
    r = trace.filter("event = 'rephrase' and outcome = 'replaced'").groupBy(*key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("t_ms", "event_id"))).alias("r_" + c) for c in over])
    x = u.join(r, key, "left")
    return x.select(*key, *[F.coalesce("r_" + c, "u." + c).alias(c) if c in over else F.col("u." + c).alias(c) for c in cols])


def timing_report(trace: DataFrame, by: list[str] = M) -> DataFrame:
    """Per ``by``: lines and skipped lines, lag p95, rate p90, per-speaker rate step p90, freeze per 10 min, how lines
    were said. ``trace`` holds unit, rephrase and skipped events."""
    rows = latest_units(trace, [*by, "id"])
    skipped = trace.filter("event = 'skipped'").select(*by, "start_ms", "end_ms")
    spans = rows.select(*by, "start_ms", "end_ms").unionByName(skipped).groupBy(*by).agg(
        (F.max("end_ms") - F.min("start_ms")).alias("ms"))
    steps = stage(rate_steps(rows, by))
    places = quantiles(steps, by, {"lag": (F.col("lag_ms"), {"lag_p95": 0.95}), "rate": (F.col("rate_pct"), {"rate_p90": 0.9}), "step": (F.col("step"), {"rate_step_p90": 0.9})})
    a = steps.groupBy(*by).agg(
        F.count("*").alias("lines"), F.sum("freeze_ms").alias("freeze_ms"),
        *[F.count_if(F.col("said") == k).alias("said_" + k) for k in ("whole", "pieces", "joined", "anchored")]).join(places, by, "left")
    x = spans.join(a, by, "left").join(skipped.groupBy(*by).agg(F.count("*").alias("skipped")), by, "left")
    return (x.na.fill(0, ["lines", "skipped", "said_whole", "said_pieces", "said_joined", "said_anchored"])
            .withColumn("freeze_s_per_10min", F.when(F.col("ms") > 0, F.col("freeze_ms") * 600.0 / F.col("ms"))).drop("ms", "freeze_ms"))


def plan_stats(plans: DataFrame, by: list[str] = M, late_ms: int = 500, cap_pct: int = 120, smooth_pct: int = 10) -> DataFrame:
    """Statistics over placed lines. ``plans(by, id, speaker, src_start_ms, src_end_ms, start_ms, end_ms, rate_pct,
    overdraft_ms, own_overdraft_ms, freeze_ms, said)``."""
    x = scan(plans, by, ["src_start_ms", "id"], bucket_of("src_start_ms", CHUNK), __po=prev("overdraft_ms"))
    x = scan(x, [*by, "speaker"], ["src_start_ms", "id"], bucket_of("src_start_ms", CHUNK), __pr=prev("rate_pct"))
    lag = F.col("start_ms") - F.col("src_start_ms")
    step = F.abs(F.col("rate_pct") - F.col("__pr"))
    x = stage(x)
    places = quantiles(x, by, {"lag": (lag, {"lag_p50": 0.5, "lag_p95": 0.95}), "rate": (F.col("rate_pct"), {"rate_p50": 0.5, "rate_p90": 0.9}), "step": (step, {"rate_step_p90": 0.9})})
    end = F.greatest("end_ms", "start_ms")
    union = F.greatest(end, F.col("src_end_ms")) - F.least("start_ms", "src_start_ms")
    iou = F.when(union > 0, F.greatest(F.least(end, F.col("src_end_ms")) - F.greatest("start_ms", "src_start_ms"), F.lit(0)) / union).otherwise(1.0)

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    return x.groupBy(*by).agg(
        F.count("*").alias("lines"), (F.max("src_end_ms") - F.min("src_start_ms")).alias("span_ms"),
        F.max(lag).alias("lag_max"), F.min(lag).alias("lag_min"),
        F.coalesce(F.max(F.when(F.coalesce(F.col("__po"), F.lit(0)) <= 0, lag)), F.lit(0)).alias("lag_max_unflagged"),
        share(lag > late_ms).alias("late_share"), F.avg("rate_pct").alias("rate_mean"),
        F.max("rate_pct").alias("rate_max"), share(F.col("rate_pct") >= cap_pct).alias("at_cap_share"),
        F.coalesce(F.avg(F.when(step.isNotNull(), F.when(step <= smooth_pct, 1.0).otherwise(0.0))), F.lit(1.0)).alias("rate_step_ok_share"),
        F.count_if(F.col("freeze_ms") > 0).alias("freezes"), F.sum("freeze_ms").alias("freeze_ms"),
        F.sum("own_overdraft_ms").alias("overdraft_ms"), F.count_if(F.col("own_overdraft_ms") > 0).alias("overdraft_lines"),
        F.sum(F.col("overdraft_ms") - F.col("own_overdraft_ms")).alias("carried_ms"), F.avg(iou).alias("iou_mean"),
        *[F.count_if(F.col("said") == k).alias("said_" + k) for k in ("pieces", "joined", "anchored")]).join(places, by, "left").na.fill(0.0, ["rate_step_p90"])


def guards(stats: DataFrame, baseline: DataFrame | None = None, by: list[str] = M) -> DataFrame:
    """Acceptance guards, one row each: (by, guard, value, limit, ok); ok is NULL where value or limit is unknown. Times in
    seconds, rates as factors. ``baseline`` (same columns) gives the limits measured against an earlier run."""
    cols = ["rate_step_p90", "end_early_1s_share", "long_end_error_p50"]
    x = stats
    if baseline is None:
        x = x.withColumns({"b_" + c: F.lit(None).cast("double") for c in cols})
    else:
        x = x.join(baseline.select(*by, *[F.col(c).alias("b_" + c) for c in cols]), by, "left")
    lim = {"lag_p95": F.lit(0.3), "rate_p90": F.lit(1.1), "freeze_s_per_10min": F.lit(1.0), "rate_step_p90": F.col("b_rate_step_p90"),
           "silent_s_per_min": F.lit(3.0), "end_error_p50": F.lit(0.3), "end_early_1s_share": F.col("b_end_early_1s_share") / 2,
           "long_end_error_p50": F.abs("b_long_end_error_p50") / 2}
    signed = {"end_error_p50", "long_end_error_p50"}
    rows = F.array(*[F.struct(F.lit(k).alias("guard"), F.col(k).cast("double").alias("value"), v.cast("double").alias("limit"),
                              ((F.abs(k) if k in signed else F.col(k)) <= v + 1e-9).alias("ok")) for k, v in lim.items()])
    return x.select(*by, F.inline(rows))


def dub_metrics(lines: DataFrame, by: list[str] = M, band: tuple[float, float] = (0.9, 1.2)) -> DataFrame:
    """Fill metrics over voiced lines: coverage class shares, retranslations kept, speech fill as a ratio of sums and as a
    median, share of required rates in the band. ``lines(by, cls, cls_first, verdict_by, take_ms, played_ms, speech_ms)``."""
    x = lines.filter("take_ms > 0 and speech_ms > 0")
    rate, fill = F.col("take_ms") / F.col("speech_ms"), F.col("played_ms") / F.col("speech_ms")
    kinds = ["C", "m", "P", "E", "other_tier", "unreviewed"]

    def shares(c: str, p: str) -> list[Column]:
        return [F.avg(F.when(F.col(c) == k, 1.0).otherwise(0.0)).alias(p + k) for k in kinds]

    return x.groupBy(*by).agg(F.count("*").alias("lines"), *shares("cls", "share_"), *shares("cls_first", "first_"),
                              F.count_if(F.col("verdict_by") == "validators").alias("retranslations_kept"),
                              (F.sum("played_ms") / F.sum("speech_ms")).alias("speech_fill"),
                              F.avg(F.when(rate.between(*band), 1.0).otherwise(0.0)).alias("rate_in_band_share")).join(
        quantiles(x, by, {"fill": (fill, {"speech_fill_median": 0.5})}), by, "left")


def online_pace(takes: DataFrame, voice: list[str] = ["voice"], order: list[str] = ["at"]) -> DataFrame:
    """Pace of each voice after its takes in order: robust recursive least squares of seconds on units, with forgetting.
    ``takes(voice, order, units, seconds)`` -> (voice, rate, overhead, n).

    Each take changes how the next one counts, so a voice's takes are read in order; a window numbers them (and spills), so they
    lie whole and in order in one partition whatever join came before, and are streamed past one small model, never gathered.
    A repartition does not say so: it is dropped after a join by voice, and adaptive execution then reads the join's shuffle
    in pieces."""
    t = takes.schema
    x = takes.select(*voice, *order, F.col("units").cast("double").alias("units"), F.col("seconds").cast("double").alias("seconds"))
    out = ", ".join([*(f"{v} {t[v].dataType.simpleString()}" for v in voice), "rate double", "overhead double", "n bigint"])
    names = list(voice)
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy(*voice).orderBy(*order)))
    return x.mapInPandas(lambda b: model.fold(b, names), out)


def calibrate_pace(takes: DataFrame, voice: list[str] = ["voice"], order: list[str] = ["at"]) -> DataFrame:
    """Rate and overhead of each voice by least squares of seconds on units; an overhead outside [0, 1] s is clamped and the
    rate refitted through it; voices with one length fall back to ``online_pace``. All sums, so takes combine before any
    shuffle."""
    u, s = F.col("units").cast("double"), F.col("seconds").cast("double")
    g = takes.groupBy(*voice).agg(F.count("*").alias("n"), F.regr_slope(s, u).alias("inv0"), F.regr_intercept(s, u).alias("ov0"),
                                  F.sum(u).alias("su"), F.sum(s).alias("ss"), F.sum(u * u).alias("suu"), F.sum(u * s).alias("sus"),
                                  (F.min(u) < F.max(u)).alias("direct"))
    ov = F.least(F.greatest("ov0", F.lit(0.0)), F.lit(model.OVERHEAD_MAX))
    inv = F.when(F.col("ov0").between(0.0, model.OVERHEAD_MAX), F.col("inv0")).otherwise((F.col("sus") - ov * F.col("su")) / F.col("suu"))
    inv = F.least(F.greatest(inv, F.lit(1 / model.RATE_MAX)), F.lit(1 / model.RATE_MIN))
    fit = g.filter("direct").select(*voice, (1 / inv).alias("rate"), ov.alias("overhead"), "n")
    one = takes.join(g.filter("not direct").select(*voice), voice, "left_semi")
    return fit.unionByName(online_pace(one, voice, order))


def estimate_duration(lines: DataFrame, pace: DataFrame, voice: list[str] = ["voice"], units: str = "units") -> DataFrame:
    """Lines with ``est_s``: overhead + units / rate, at least 0.05 s; a voice not yet heard takes the prior."""
    x = lines.join(pace.select(*voice, "rate", "overhead"), voice, "left").na.fill({"rate": model.RATE0, "overhead": model.OVERHEAD0})
    return x.withColumn("est_s", F.greatest(F.col("overhead") + F.col(units) / F.col("rate"), F.lit(0.05)))


def wall_time(points: DataFrame, edits: DataFrame, at: str, key: list[str], by: list[str] = M) -> DataFrame:
    """``points`` with ``wall_ms``: when video time ``at`` is shown, after the slow-downs and freezes before it. A freeze at
    the same time counts. ``edits(by, at_ms, span_ms, rate, added_ms)``; rate NULL means a freeze.

    Time added by edits that end before a point is a running total carried across chunks; only edits still running at the
    point are range-joined."""
    e = edits.withColumn("__add", F.when(F.col("rate").isNull(), F.col("added_ms").cast("double"))
                         .otherwise(F.col("span_ms") / F.col("rate") - F.col("span_ms")))
    done = e.select(*by, (F.col("at_ms") + F.when(F.col("rate").isNull(), 0).otherwise(F.col("span_ms"))).alias("__t"), F.lit(0).alias("__k"),
                    F.col("__add"), *[F.lit(None).cast(points.schema[k].dataType).alias(k) for k in key])
    pts = points.select(*by, F.col(at).alias("__t"), F.lit(1).alias("__k"), F.lit(0.0).alias("__add"), *key)
    from ..functions.scan import running_sum
    total = scan(done.unionByName(pts), by, ["__t", "__k", *key], bucket_of("__t", CHUNK), __sum=running_sum("__add"))
    total = total.filter("__k = 1").select(*by, *key, "__sum")
    slow = e.filter("rate is not null").select(*by, F.col("at_ms").alias("start_ms"), (F.col("at_ms") + F.col("span_ms")).alias("end_ms"), "rate")
    part = (point_join(points.select(*by, *key, at), slow, by, at).filter((F.col(at) > F.col("b_start_ms")) & (F.col(at) < F.col("b_end_ms")))
            .groupBy(*by, *key).agg(F.sum((F.col(at) - F.col("b_start_ms")) * (1 / F.col("b_rate") - 1)).alias("__part")))
    x = points.join(total, [*by, *key], "left").join(part, [*by, *key], "left")
    return x.withColumn("wall_ms", F.col(at) + F.coalesce("__sum", F.lit(0.0)) + F.coalesce("__part", F.lit(0.0))).drop("__sum", "__part")


def scale_sweep(lines: DataFrame, scales: list[float], dur: str = "dur_ms", by: list[str] = M) -> DataFrame:
    """Feasibility at several duration scales: per (by, scale) lines, share fitting at speed 1, share condensed, added time
    and rate percentiles. The scales are exploded as a literal array, not joined."""
    s = line_slots(lines, by)
    x = s.withColumn("scale", F.explode(F.array(*[F.lit(float(v)) for v in scales])))
    x = x.withColumns({"__d": F.col(dur) * F.col("scale"), "budget_ms": budget_ms()})
    rate = F.when(F.col("__d") <= F.col("budget_ms"), 1.0).otherwise(F.least(F.col("__d") / F.col("budget_ms"), F.lit(1.25)))
    over = F.greatest(F.col("__d") / rate - F.col("budget_ms"), F.lit(0.0))
    x = stage(x.select(*by, "scale", "__d", "budget_ms"))
    places = quantiles(x, [*by, "scale"], {"rate": (rate, {"rate_p50": 0.5, "rate_p90": 0.9})}, fused=True)
    return x.groupBy(*by, "scale").agg(
        F.count("*").alias("lines"), F.avg(F.when(F.col("__d") <= F.col("budget_ms"), 1.0).otherwise(0.0)).alias("fits_share"),
        F.avg(F.when(F.col("__d") > F.col("budget_ms") * 1.05, 1.0).otherwise(0.0)).alias("condense_share"),
        F.sum(F.round(over)).alias("overflow_ms")).join(places, [*by, "scale"], "left")


def anchor_errors(parts: DataFrame, voiced: DataFrame, key: list[str] = ["media_id", "id"]) -> DataFrame:
    """For each timed part after a line's first: its first voiced onset at or after the part's start (1 ms slack) minus its
    source onset. ``parts(key, part, start_ms, src_ms)``; ``voiced(key, start_ms, end_ms)``. A line has few of either."""
    p = parts.filter("part > 0 and src_ms is not null")
    j = p.join(voiced.select(*key, F.col("start_ms").alias("__v")), key).filter(F.col("__v") >= F.col("start_ms") - 1)
    return (j.groupBy(*key, "part", "src_ms").agg(F.min("__v").alias("__on"))
            .select(*key, "part", (F.col("__on") - F.col("src_ms")).alias("error_ms")))


def match_breaks(lines: DataFrame) -> DataFrame:
    """Choose the breaks that meet a take's joins: those whose share of the source speech before them best matches the
    share said before each join, the first in order on a tie. ``lines(…, durations ARRAY, break_share ARRAY)`` (share of
    speech before each break) -> ``picked`` (0-based break indices). Choosing one break per join in order is a small
    in-row dynamic programme over the joins; no subsets are listed."""
    need = F.size("durations") - 1
    total = F.aggregate("durations", F.lit(0.0), lambda a, d: a + d)
    x = lines.withColumns({"__need": need, "__total": total})
    x = x.withColumn("__share", F.expr(
        "transform(sequence(1, greatest(__need, 1)), k -> aggregate(slice(durations, 1, k), 0.0D, (a, d) -> a + d) / __total)"))
    # best[i]: cheapest way to have placed the joins so far with the last on break i (cost, indices).
    first = "transform(break_share, (b, i) -> struct(abs(__share[0] - b) as c, array(i) as ix))"
    later = ("aggregate(if(__need > 1, sequence(1, __need - 1), array()), {0}, (best, j) -> transform(break_share, (b, i) -> "
             "array_min(concat(array(struct(double('Infinity') as c, array(i) as ix)), transform(filter(best, p -> element_at(p.ix, -1) < i "
             "and size(p.ix) = j), p -> struct(p.c + abs(__share[j] - b) as c, concat(p.ix, array(i)) as ix))))))").format(first)
    pick = F.expr(f"array_min(filter({later}, p -> size(p.ix) = __need)).ix")
    simple = F.expr("slice(transform(break_share, (b, i) -> i), 1, greatest(__need, 0))")
    out = F.when((F.size("break_share") == F.col("__need")) | (F.col("__total") <= 0) | (F.col("__need") <= 0), simple).otherwise(pick)
    return x.withColumn("picked", out).drop("__need", "__total", "__share")
