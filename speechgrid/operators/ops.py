"""Trace, usage and operations reports over a library of processing jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.scan import prev, running_max, running_sum, scan
from ..functions.spans import bucket_of
from ..session import stage
from .intervals import interval_length
from .timing import plan_stats, timing_report

M = ["media_id"]
DAY_MS = 86_400_000

# Planning priors, wall seconds per second of video in a stage's range (low, high); stages that run side by
# side; calls and lines per second of video.
PRIORS = {"fetch": (0.003, 0.01), "speakers": (0.04, 0.086), "transcript": (0.046, 0.143), "units": (0.0002, 0.001),
          "voices": (0.011, 0.023), "brief": (0.0034, 0.026), "translate": (0.23, 0.34), "voice_lines": (0.75, 1.6),
          "finish": (0.0, 0.0), "video": (0.012, 0.06), "export": (0.02, 0.05), "separate": (0.035, 0.11)}
GROUPS = {"fetch": 0, "speakers": 1, "transcript": 2, "units": 3, "voices": 4, "brief": 4, "separate": 5, "translate": 5,
          "voice_lines": 5, "finish": 5, "video": 5, "export": 6}
CALLS_PER_LINE = (0.16, 0.19)
LINES_PER_S, WORDS_PER_S, PART_WORDS = 0.18, 2.9, 8_000
PAST_STOP_MS = 30_000
# End of fixed values.


def number(c: Column, default: float = 0.0) -> Column:
    """A finite number, else ``default``."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(default)).otherwise(d)


def latest_run(trace: DataFrame, now_ms: int, by: list[str] = M, window_ms: int = 900_000) -> DataFrame:
    """Events in scope per ``by``: those of the last ``run_start`` (same run_id, from its time to now); with no run
    boundary, the last ``window_ms``, labelled so. Adds scope and since_ms."""
    start = trace.filter("event = 'run_start' and run_id is not null").groupBy(*by).agg(
        F.max_by(F.struct("run_id", "t_ms"), F.struct("t_ms", "event_id")).alias("__r"))
    x = trace.join(start, by, "left")
    since = F.coalesce("__r.t_ms", F.lit(now_ms - window_ms))
    keep = (F.col("t_ms") >= since) & (F.col("t_ms") <= now_ms) & (F.col("__r").isNull() | (F.col("run_id") == F.col("__r.run_id")))
    return x.filter(keep).select(*trace.columns, F.when(F.col("__r").isNull(), "recent_window_without_run_boundary").otherwise("latest_run")
                                 .alias("scope"), since.alias("since_ms"))


def call_usage(trace: DataFrame, by: list[str] = M, since: str | int = "since_ms", until: str | int = "until_ms") -> DataFrame:
    """Model calls by provider, model and call: counts, durations, active time (union of [t - wall, t] clipped to the scope),
    errors as a map, tokens and cached share. ``trace(by, t_ms, event, provider, model, call, wall_ms, error, input_tokens,
    cache_read_tokens, cache_creation_tokens)``."""
    s, u = (F.col(v) if isinstance(v, str) else F.lit(v).cast("bigint") for v in (since, until))
    c = trace.filter("event = 'claude'").withColumns(
        {"provider": F.coalesce("provider", F.lit("legacy")), "model": F.coalesce("model", F.lit("unknown")),
         "call": F.coalesce("call", F.lit("unknown")), "wall_ms": F.coalesce("wall_ms", F.lit(0))})
    key = [*by, "provider", "model", "call"]
    ok = F.when(F.col("error").isNull(), F.col("wall_ms"))
    a = c.groupBy(*key).agg(
        F.count("*").alias("calls"), F.max("wall_ms").alias("max_ms"), F.count(ok).alias("successful_calls"), F.max(ok).alias("successful_max_ms"),
        F.sum("wall_ms").alias("summed_ms"), F.sum("input_tokens").alias("input_tokens"), F.sum("cache_read_tokens").alias("cached_tokens"),
        F.sum("cache_creation_tokens").alias("__made")).join(
            quantiles(c, key, {"all": (F.col("wall_ms"), {"p50_ms": 0.5}), "ok": (ok, {"successful_p50_ms": 0.5})}), key, "left")
    total = (F.when(F.col("provider") == "codex", F.col("input_tokens"))
             .when(F.col("provider").isin("claude", "anthropic") | F.col("model").startswith("claude-"),
                   F.col("input_tokens") + F.col("cached_tokens") + F.col("__made")))
    a = a.withColumn("total_input_tokens", total).withColumn(
        "cached_fraction", F.when(F.col("total_input_tokens") > 0, F.col("cached_tokens") / F.col("total_input_tokens"))).drop("__made")
    active = interval_length(c.select(*key, F.greatest(s, F.col("t_ms") - F.col("wall_ms")).alias("start_ms"), F.least(u, F.col("t_ms")).alias("end_ms")),
                             key, bucket_ms=DAY_MS).withColumnRenamed("length_ms", "active_ms")
    errors = (c.filter("error is not null").groupBy(*key, "error").agg(F.count("*").alias("n")).groupBy(*key)
              .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("errors")))
    return (a.join(active, key, "left").join(errors, key, "left").na.fill(0, ["active_ms"])
            .withColumn("errors", F.coalesce("errors", F.expr("cast(map() as map<string, bigint>)"))))


def stage_table(trace: DataFrame, now_ms: int, by: list[str] = M) -> DataFrame:
    """Started stages with their last finish; an unfinished one is in_progress with the time since it started.
    ``trace(by, event_id, t_ms, event, stage, wall_ms, outcome)``."""
    order = F.struct("t_ms", "event_id")
    started = trace.filter("event = 'stage_start'").groupBy(*by, "stage").agg(F.max("t_ms").alias("start_ms"))
    done = (trace.filter("event = 'stage_timing'").groupBy(*by, "stage").agg(F.max_by(F.struct("wall_ms", "outcome"), order).alias("f")))
    return started.join(done, [*by, "stage"], "left").select(
        *by, "stage", F.coalesce("f.wall_ms", F.when(F.col("f").isNull(), F.lit(now_ms) - F.col("start_ms"))).alias("wall_ms"),
        F.when(F.col("f").isNull(), "in_progress").otherwise(F.col("f.outcome")).alias("outcome"))


def final_units(trace: DataFrame, by: list[str] = M) -> DataFrame:
    """Latest unit per id, counted by voiced class and by who gave the verdict; skipped events counted, also where there is no
    unit: (by, units, skipped, by_class MAP, by_source MAP)."""
    u = trace.filter("event = 'unit' and id is not null").groupBy(*by, "id").agg(
        F.max_by(F.struct(F.coalesce("coverage_voiced", F.lit("unknown")).alias("c"), F.coalesce("verdict_by", F.lit("unknown")).alias("v")),
                 F.struct("t_ms", "event_id")).alias("u"))

    def hist(c: str, name: str) -> DataFrame:
        return (u.groupBy(*by, F.col(c).alias("k")).agg(F.count("*").alias("n")).groupBy(*by)
                .agg(F.sum("n").alias("units"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)))

    s = trace.filter("event = 'skipped'").groupBy(*by).agg(F.count("*").alias("skipped"))
    return hist("u.c", "by_class").join(hist("u.v", "by_source").drop("units"), by).join(s, by, "full").na.fill(0, ["units", "skipped"])


def gpu_work(trace: DataFrame, by: list[str] = M) -> DataFrame:
    """Completed device work by stage and operation: calls, run and wait time; numbers that are none count 0."""
    return trace.filter("event = 'gpu_work'").groupBy(*by, F.coalesce("stage", F.lit("unknown")).alias("stage"),
                                                      F.coalesce("operation", F.lit("unknown")).alias("operation")).agg(
        F.count("*").alias("calls"), F.sum(number(F.col("run_ms"))).alias("run_ms"), F.sum(number(F.col("wait_ms"))).alias("wait_ms"))


def progress_delta(cur: DataFrame, prior: DataFrame, key: list[str] = ["media_id", "stage"]) -> DataFrame:
    """Units per second since an earlier snapshot, for stages of the same run with the same total that did not go back.
    Both: (key, run_id, done, total, unit, observed_ms)."""
    p = prior.select(*key, *[F.col(c).alias("p_" + c) for c in ("run_id", "done", "total", "observed_ms")])
    ms = F.col("observed_ms") - F.col("p_observed_ms")
    return (cur.join(p, key).filter(F.col("run_id").eqNullSafe(F.col("p_run_id")) & F.col("total").eqNullSafe(F.col("p_total"))
                                    & (ms > 0) & (F.col("done") >= F.col("p_done")))
            .select(*key, (F.col("done") - F.col("p_done")).alias("advanced"), ms.alias("interval_ms"),
                    ((F.col("done") - F.col("p_done")) * 1000.0 / ms).alias("per_second"), "unit"))


def render_metrics(trace: DataFrame, durations: DataFrame, by: list[str] = M) -> DataFrame:
    """One run's yardsticks: stages done and cached, seconds, device seconds, device seconds per second of video, model
    calls and tokens. The last ``stage`` event of a key wins. ``trace(…, stage, seconds, gpu_s, cached, call, …tokens)``."""
    st = trace.filter("event = 'stage'").groupBy(*by, "stage").agg(
        F.max_by(F.struct("seconds", "gpu_s", "cached"), F.struct("t_ms", "event_id")).alias("s"))
    a = st.groupBy(*by).agg(F.count("*").alias("stages"), F.count_if("s.cached").alias("cached_stages"), F.sum("s.seconds").alias("seconds"),
                            F.sum("s.gpu_s").alias("gpu_s"))
    c = trace.filter("event = 'claude'").groupBy(*by).agg(F.count("*").alias("calls"), *[
        F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in ("input_tokens", "cache_read_tokens", "output_tokens")])
    x = a.join(c, by, "full").join(durations.select(*by, "duration_ms"), by, "left")
    return x.withColumn("gpu_s_per_video_s", F.when(F.col("duration_ms") > 0, F.col("gpu_s") * 1000.0 / F.col("duration_ms"))).drop("duration_ms")


def _stage_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, GROUPS[k], float(a), float(b)) for k, (a, b) in PRIORS.items()], "stage string, grp int, lo double, hi double")


def _range_ms(stop: Column, duration: Column) -> Column:
    """Milliseconds of video in a stage's range: the whole, or up to a preview's stop point and a little past it."""
    late = F.col("stage").isin("translate", "voice_lines", "finish", "export")
    return (F.when(stop.isNull(), duration).when(F.col("stage") == "separate", F.least(duration, stop + 2 * PAST_STOP_MS))
            .when(late, F.least(duration, stop + PAST_STOP_MS)).otherwise(duration))


def _group_total(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Total of stage seconds: stages of a group run side by side (the longest counts), groups in turn; in the group of the
    background stage the device runs it and then the longer of voice and finish."""
    def one(c: str) -> Column:
        def pick(*names: str) -> Column:
            return F.coalesce(F.max(F.when(F.col("stage").isin(*names), F.col(c))), F.lit(0.0))
        series = pick("separate") + pick("voice_lines", "finish")
        return F.when(F.col("grp") == 5, F.greatest(series, pick("translate", "video"))).otherwise(F.max(c)).alias(c)
    return df.groupBy(*by, "grp").agg(*[one(c) for c in cols]).groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])


def time_left(jobs: DataFrame, job_stages: DataFrame, by: list[str] = ["job_id"]) -> DataFrame:
    """Seconds each job has left by the priors: per stage the mean prior times its range times the share left; a stage done
    for a shorter range has the added range left. ``jobs(by, duration_ms, stop_ms)``, ``job_stages(by, stage, state, done,
    total, span_ms)``."""
    x = jobs.crossJoin(F.broadcast(_stage_table(jobs.sparkSession))).join(job_stages, [*by, "stage"], "left")
    rng = _range_ms(F.col("stop_ms"), F.col("duration_ms"))
    share = F.when(F.col("total") > 0, F.least(F.greatest(1.0 - F.col("done") / F.col("total"), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    left = F.when(F.col("state") == "done", F.coalesce(F.greatest(rng - F.col("span_ms"), F.lit(0)), F.lit(0)).cast("double")).otherwise(rng * share)
    x = x.withColumn("left_s", (F.col("lo") + F.col("hi")) / 2 * left / 1000)
    return _group_total(x, by, ["left_s"])


def estimate(jobs: DataFrame, by: list[str] = ["job_id"]) -> DataFrame:
    """What a job should take from scratch: seconds low and high, model calls low and high."""
    x = jobs.crossJoin(F.broadcast(_stage_table(jobs.sparkSession)))
    rng = _range_ms(F.col("stop_ms"), F.col("duration_ms")) / 1000
    x = x.withColumns({"low_s": F.col("lo") * rng, "high_s": F.col("hi") * rng})
    t = _group_total(x, by, ["low_s", "high_s"])
    stop = F.when(F.col("stop_ms").isNull(), F.col("duration_ms")).otherwise(F.least("duration_ms", F.col("stop_ms") + PAST_STOP_MS))
    lines = stop / 1000 * LINES_PER_S
    parts = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / 1000 * WORDS_PER_S / PART_WORDS))
    calls = jobs.select(*by, *[(F.bround(lines * k, 0) + parts).alias(n) for k, n in zip(CALLS_PER_LINE, ("calls_low", "calls_high"))])
    return t.join(calls, by)


def eta(progress: DataFrame, priors: DataFrame, key: list[str] = ["job_id", "stage"], after_ms: int = 30_000) -> DataFrame:
    """Seconds left per running stage: remaining work at its own rate once it has 30 s of work behind it, else the prior.
    ``progress(key, t_ms, done, total)``, ``priors(key, left_s)``."""
    p = progress.groupBy(*key).agg(F.min_by("done", "t_ms").alias("d0"), F.min("t_ms").alias("t0"), F.max_by("done", "t_ms").alias("d1"),
                                   F.max("t_ms").alias("t1"), F.max_by("total", "t_ms").alias("total"))
    rate = (F.col("t1") - F.col("t0") >= after_ms) & (F.col("d1") > F.col("d0"))
    own = F.greatest(F.col("total") - F.col("d1"), F.lit(0)) * (F.col("t1") - F.col("t0")) / 1000.0 / (F.col("d1") - F.col("d0"))
    return p.join(priors.select(*key, "left_s"), key, "left").select(*key, F.when(rate, own).otherwise(F.col("left_s")).alias("eta_s"))


def queue_report(jobs: DataFrame, left: DataFrame, by: str = "job_id") -> DataFrame:
    """First-in-first-out position of queued jobs and the seconds of work before each: what the running jobs and the queued
    ones ahead have left. The order is carried across day chunks, so the queue is never in one task whole. The seconds are added
    as decimals (to 1e-12), so the sums are those of any order and of any length of the queue."""
    x = jobs.filter("status = 'queued'").join(left.select(by, "left_s"), by, "left").na.fill(0.0, ["left_s"])
    exact = F.col("left_s").cast("decimal(27,12)")
    running = jobs.filter("status = 'running'").join(left.select(by, "left_s"), by).agg(F.coalesce(F.sum(exact), F.lit(0)).alias("__run"))
    x = scan(x, [], ["queued_ms", by], bucket_of("queued_ms", DAY_MS), position=running_sum(F.lit(1).cast("bigint")),
             __ahead=running_sum(exact, inclusive=False))
    return x.crossJoin(F.broadcast(running)).select(by, "position", (F.col("__ahead") + F.col("__run")).cast("double").alias("ahead_s"))


def orphan_keys(files: DataFrame, refs: DataFrame, key: str = "key") -> DataFrame:
    """Files whose key no current row names (reported, never deleted)."""
    return files.join(refs.select(key).distinct(), key, "left_anti")


def retention(jobs: DataFrame, now_ms: int, keep: DataFrame | None = None, days: int = 14, cap: int = 5_000_000_000, by: str = "job_id") -> DataFrame:
    """Jobs to expire: those not touched for ``days`` (``age``); then, while reclaimable jobs hold more than ``cap`` bytes,
    done whole jobs, least recently touched first (``size``). Queued and kept jobs are exempt; jobs expired before count
    toward the size but are listed only if they hold bytes. ``jobs(by, status, updated_ms, bytes, stop_ms, expired)``."""
    x = jobs.filter("status is distinct from 'queued'")
    if keep is not None:
        x = x.join(keep.select(by), by, "left_anti")
    x = x.withColumns({"__age": ~F.col("expired") & (F.lit(now_ms) - F.col("updated_ms") > days * DAY_MS),
                       "__cap": F.col("expired") | ((F.col("status") == "done") & F.col("stop_ms").isNull())})
    # Jobs already leaving by age still count toward the size and are skipped by the sweep, as they free nothing more.
    size = x.filter("__cap").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("__size"))
    x = scan(x, [], ["updated_ms", by], bucket_of("updated_ms", DAY_MS),
             __freed=running_sum(F.when(F.col("__cap") & ~F.col("__age"), F.col("bytes")).otherwise(0), inclusive=False))
    x = x.crossJoin(F.broadcast(size))
    over = F.col("__cap") & ~F.col("__age") & (F.col("__size") - F.col("__freed") > cap) & ((F.col("bytes") > 0) | ~F.col("expired"))
    return x.select(by, F.when(F.col("__age"), "age").when(over, "size").alias("why"), "bytes").filter("why is not null")


def clock_gaps(ticks: DataFrame, by: list[str] = M, gap_ms: int = 60_000) -> DataFrame:
    """Sleeps: between two ticks the wall clock moved more than ``gap_ms`` past the monotonic one."""
    x = scan(ticks, by, ["wall_ms"], bucket_of("wall_ms", DAY_MS), __w=prev("wall_ms"), __m=prev("mono_ms"))
    slept = (F.col("wall_ms") - F.col("__w")) - (F.col("mono_ms") - F.col("__m"))
    return x.filter(slept > gap_ms).select(*by, F.col("__w").alias("at_ms"), F.col("wall_ms").alias("resumed_ms"), slept.alias("slept_ms"))


def job_report(lines: DataFrame, by: list[str] = M) -> DataFrame:
    """Lines, lines flagged long or unreviewed, own and carried overdraft. ``lines(by, flags ARRAY, own_ms, carried_ms)``."""
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), F.count_if(F.array_contains("flags", "long")).alias("long"),
                                  F.count_if(F.array_contains("flags", "unreviewed")).alias("unreviewed"),
                                  F.sum("own_ms").alias("overdraft_ms"), F.sum("carried_ms").alias("carried_ms"))


def job_list(jobs: DataFrame, job_stages: DataFrame, by: str = "job_id") -> DataFrame:
    """Stages as shown: a ``done`` one whose span is shorter than the range now asked for shows ``todo``; with the job's
    last activity to order by, newest first."""
    x = job_stages.join(jobs.select(by, "updated_ms", "duration_ms", "stop_ms"), by)
    rng = _range_ms(F.col("stop_ms"), F.col("duration_ms"))
    shown = F.when((F.col("state") == "done") & F.col("span_ms").isNotNull() & (F.col("span_ms") < rng - 50), "todo").otherwise(F.col("state"))
    return x.select(by, "updated_ms", "stage", shown.alias("state")).orderBy(F.desc("updated_ms"), by, "stage")


def snapshot(jobs: DataFrame, trace: DataFrame, now_ms: int, by: list[str] = M) -> DataFrame:
    """One row per job: status, run scope and its observed time, calls, active model time, device work, units and skips, and the
    run's stages with wall time and outcome, by name. Only numbers, keys and labels leave; no column with text of the recording is
    selected."""
    sc = latest_run(trace, now_ms, by)
    scope = sc.groupBy(*by).agg(F.first("scope").alias("scope"), F.min("since_ms").alias("since_ms"), F.count("*").alias("events"),
                                F.max(F.when(F.col("event") == "run_end", F.col("t_ms"))).alias("ended_ms"))
    use = call_usage(sc, by, "since_ms", now_ms).groupBy(*by).agg(F.sum("calls").alias("calls"), F.sum("active_ms").alias("active_ms"))
    gpu = gpu_work(sc, by).groupBy(*by).agg(F.sum("run_ms").alias("gpu_run_ms"))
    fin = final_units(sc, by).select(*by, "units", "skipped")
    stages = stage_table(sc.filter("stage is not null"), now_ms, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("stage", "wall_ms", "outcome"))).alias("stages"))
    x = jobs.select(*by, "status", "queued_ms", "updated_ms").join(scope, by, "left")
    for d in (use, gpu, fin, stages):
        x = x.join(d, by, "left")
    return (x.withColumns({"scope": F.coalesce("scope", F.lit("recent_window_without_run_boundary")),
                           "observed_ms": F.coalesce("ended_ms", F.lit(now_ms)) - F.col("since_ms")}).drop("ended_ms")
            .na.fill(0, ["events", "calls", "active_ms", "gpu_run_ms", "units", "skipped"]))


def manifest(lines: DataFrame, skips: DataFrame, speakers: DataFrame, by: list[str] = M) -> DataFrame:
    """Final figures per recording: lines, skipped, speakers, lag and rate percentiles, overdraft own and carried. ``lines``
    are the placed lines of ``plan_stats``; ``speakers(by, speaker, talk_ms)``."""
    st = plan_stats(lines, by).select(*by, "lines", "lag_p95", "rate_p90", "overdraft_ms", "carried_ms")
    sk = skips.groupBy(*by).agg(F.count("*").alias("skipped"))
    sp = speakers.groupBy(*by).agg(F.count("*").alias("speakers"), F.sum("talk_ms").alias("talk_ms"))
    return st.join(sk, by, "left").join(sp, by, "left").na.fill(0, ["skipped", "speakers", "talk_ms"])


def compare_arms(runs: DataFrame, base: str, metric: str = "value", key: list[str] = ["pair"]) -> DataFrame:
    """Per arm: median of the metric over complete pairs (every arm measured) and the median paired change from ``base``."""
    arms = runs.select("arm").distinct().agg(F.count("*").alias("__n"))
    full = (runs.filter(F.col(metric).isNotNull()).groupBy(*key).agg(F.count_distinct("arm").alias("__k"))
            .crossJoin(F.broadcast(arms)).filter("__k = __n").select(*key))
    x = runs.join(full, key, "left_semi")
    b = x.filter(F.col("arm") == base).select(*key, F.col(metric).alias("__b"))
    change = (F.col(metric) - F.col("__b")) / F.col("__b")
    x = stage(x.join(b, key).select("arm", F.col(metric).alias("__v"), change.alias("__change")))
    return x.groupBy("arm").agg(F.count("*").alias("pairs")).join(
        quantiles(x, ["arm"], {"value": (F.col("__v"), {"median": 0.5}), "change": (F.col("__change"), {"median_change": 0.5})}), "arm", "left")


def blind_rows(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Rows with a ``blind_id`` that tells neither arm nor order: places in the order of a seeded hash of the key. Hash
    ranges are ranked apart, so the numbering needs no global sort."""
    h = F.xxhash64(F.lit(seed), *key)
    x = rows.withColumn("__h", h)
    return scan(x, [], ["__h", *key], F.shiftright("__h", 44), blind_id=running_sum(F.lit(1).cast("bigint"))).drop("__h")


def ready_prefix(scenes: DataFrame, by: list[str] = M) -> DataFrame:
    """When the contiguous prefix of ready scenes grew: one row per growth with the scenes, lines and source time covered.
    ``scenes(by, scene, lines, end_ms, ready_ms)``; scenes numbered in order, ready_ms NULL while not ready."""
    late = 9_223_372_036_854_775_807
    x = scan(scenes.withColumn("__r", F.coalesce("ready_ms", F.lit(late))), by, ["scene"], F.expr("scene div 4096"),
             __before=running_max("__r"), scenes=running_sum(F.lit(1).cast("bigint")), covered_lines=running_sum("lines"))
    x = x.withColumn("at_ms", F.greatest("__r", F.coalesce("__before", F.lit(0)))).filter(F.col("at_ms") < late)
    return x.groupBy(*by, "at_ms").agg(F.max("scenes").alias("scenes"), F.max("covered_lines").alias("lines"),
                                       F.max_by("end_ms", "scene").alias("source_until_ms"))
