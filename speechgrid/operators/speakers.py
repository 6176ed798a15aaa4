"""Speaker analytics: linking block labels into speakers, settling and keeping ids, talk statistics, reference spans."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.scan import running_max, running_sum, scan
from ..functions.spans import bucket_of, overlap_join
from ..functions.vectors import dot, unit_vector
from ..session import stage
from . import linking
from .intervals import (MIN_PIECE_MS, activity, candidate_windows, coverage, interval_split, interval_subtract, interval_union,
                        is_covered, join_turns)

cloudpickle.register_pickle_by_value(linking)  # executors need no copy of this package

M = ["media_id"]
CHUNK = 600_000
# Linking thresholds and clip scoring, in milliseconds where they are times.
LENGTH_SAT_MS, ISOLATION_CAP_MS, BRIDGE_MS, CLEAN_MAX_MS, ADJACENT_MS, GUARD_MS = 8_000, 2_000, 600, 10_000, 1_000, 300
MIN_TALK_MS, MIN_SHARE, SAME_COS, FLOOR_CAP = 30_000, 0.01, 0.85, 0.1
SCORE_TOP, SCORE_TIE = 8, 0.05
# End of fixed values.


def shared_speech(block_turns: DataFrame, registry: DataFrame, by: list[str] = M) -> DataFrame:
    """Milliseconds of exclusive speech each block label shares with each known speaker: (by, block_no, label, speaker, ms)."""
    j = overlap_join(block_turns.select(*by, "block_no", "label", "start_ms", "end_ms"), registry.select(*by, "speaker", "start_ms", "end_ms"), by)
    return j.groupBy(*by, "block_no", "label", F.col("b_speaker").alias("speaker")).agg(F.sum("overlap_ms").alias("ms"))


def link_speakers(blocks: DataFrame, turns: DataFrame, centroids: DataFrame, by: list[str] = M) -> DataFrame:
    """Stable speaker ids for block labels: (by, block_no, label, speaker); labels that match nobody and found none are NULL.
    ``blocks(by, block_no, start_ms, end_ms)``, ``turns(by, block_no, label, start_ms, end_ms)`` exclusive,
    ``centroids(by, block_no, label, centroid)``.

    All interval work is joined and summed first: a label's talk, its new speech outside earlier blocks, and the speech it
    shares with each earlier label. What is left is one short row per label and block; each block depends on the ids given
    before it, so those rows stream in block order, a block at a time."""
    t = stage(interval_clip_to_block(turns, blocks, by))
    earlier = overlap_join(blocks, blocks, by).filter("b_block_no < block_no").select(
        *by, "block_no", F.col("b_start_ms").alias("start_ms"), F.col("b_end_ms").alias("end_ms"))
    fresh = interval_subtract(blocks.select(*by, "block_no", "start_ms", "end_ms"), earlier, [*by, "block_no"])
    new = overlap_join(t, fresh, [*by, "block_no"]).select(
        *by, "block_no", "label", F.greatest("start_ms", "b_start_ms").alias("start_ms"), F.least("end_ms", "b_end_ms").alias("end_ms"))
    new = stage(new.filter(F.col("end_ms") - F.col("start_ms") >= MIN_PIECE_MS))
    talk = t.groupBy(*by, "block_no", "label").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"))
    first = new.groupBy(*by, "block_no", "label").agg(F.min("start_ms").alias("first_ms"))
    pairs = (overlap_join(t, new, by).filter("b_block_no < block_no").groupBy(*by, "block_no", "label", "b_block_no", "b_label")
             .agg(F.sum("overlap_ms").alias("ms")).groupBy(*by, "block_no", "label")
             .agg(F.collect_list(F.struct(F.col("b_block_no").alias("block_no"), F.col("b_label").alias("label"), "ms")).alias("shared")))
    key = [*by, "block_no", "label"]
    c = centroids.select(*key, unit_vector("centroid").alias("centroid"))
    rows = talk.join(c, key, "full").join(first, key, "left").join(pairs, key, "left").na.fill(0, ["talk_ms"])
    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in key), "speaker string"])
    return rows.repartition(*by).sortWithinPartitions(*key).mapInPandas(linking.link_stream(by), out)


def interval_clip_to_block(turns: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Turns clipped to their own block; slivers left out."""
    b = blocks.select(*by, "block_no", F.col("start_ms").alias("__a"), F.col("end_ms").alias("__z"))
    x = turns.join(b, [*by, "block_no"]).select(*by, "block_no", "label", F.greatest("start_ms", "__a").alias("start_ms"),
                                               F.least("end_ms", "__z").alias("end_ms"))
    return x.filter(F.col("end_ms") - F.col("start_ms") >= MIN_PIECE_MS)


def merge_centroids(rows: DataFrame, by: list[str] = ["media_id", "speaker"]) -> DataFrame:
    """Talk-weighted mean of each speaker's block centroids (weight floor 0.1 s) at length one: (by, centroid, weight_ms).
    Sums element by element, so partial sums combine before the shuffle. ``rows(by, centroid, talk_ms)``."""
    w = F.greatest(F.col("talk_ms"), F.lit(100)).cast("double")
    x = rows.select(*by, unit_vector("centroid").alias("c"), w.alias("w")).filter("c is not null")
    e = x.select(*by, "w", F.posexplode("c").alias("i", "v")).groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum("w").alias("w"))
    g = e.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"), F.max("w").alias("weight_ms"))
    return g.select(*by, unit_vector(F.transform("p", lambda q: q["v"])).alias("centroid"), "weight_ms")


def remap_speakers(turns: DataFrame, ids: DataFrame, by: list[str] = M) -> DataFrame:
    """Turns under new speaker ids (``ids(by, speaker, new_speaker)``; several old ids may share a new one: a merge), touching
    pieces of one speaker joined."""
    x = turns.join(ids.select(*by, "speaker", "new_speaker"), [*by, "speaker"], "left")
    return join_turns(x.select(*by, F.coalesce("new_speaker", "speaker").alias("speaker"), "start_ms", "end_ms"), by)


def rename_collisions(speakers: DataFrame, ids: DataFrame, by: list[str] = M) -> DataFrame:
    """Renames that would give two speakers one id: (by, speaker, n). Empty when a rename is valid."""
    x = speakers.select(*by, "speaker").distinct().join(ids.select(*by, "speaker", "new_speaker"), [*by, "speaker"], "left")
    return x.groupBy(*by, F.coalesce("new_speaker", "speaker").alias("speaker")).agg(F.count("*").alias("n")).filter("n > 1")


def settle_speakers(speakers: DataFrame, turns: DataFrame, by: list[str] = M, hinted: bool = False) -> DataFrame:
    """Fold over-split speakers back and renumber by first speech: (by, speaker, final_speaker, into, why, step); ``into`` and
    ``why`` (talk, same) are set for merged ones, ``step`` orders the merges. ``speakers(by, speaker, centroid, talk_ms,
    first_ms)``; ``turns`` exclusive.

    Rounds for all recordings at once: each recording with something to merge makes one merge a round, so there are as many
    rounds as the most split recording has merges. A round joins the one speaker to go with the others of its recording; the
    speech lying next to each other's turns was summed before."""
    no = F.when(F.rlike("speaker", F.lit("^S[0-9]+$")), F.substring("speaker", 2, 18).cast("bigint")).otherwise(0)
    wide = turns.select(*by, "speaker", (F.col("start_ms") - ADJACENT_MS).alias("start_ms"), (F.col("end_ms") + ADJACENT_MS).alias("end_ms"))
    near = stage(overlap_join(wide, turns.select(*by, "speaker", "start_ms", "end_ms"), by).filter("speaker <> b_speaker")
                 .groupBy(*by, "speaker", F.col("b_speaker").alias("other")).agg(F.sum("overlap_ms").alias("ms")))
    total = F.sum("talk_ms")
    floors = speakers.groupBy(*by).agg(F.least(F.greatest(F.lit(float(MIN_TALK_MS)), MIN_SHARE * total), FLOOR_CAP * total).alias("floor"))
    live = stage(speakers.select(*by, "speaker", no.alias("no"), unit_vector("centroid").alias("c"), F.col("talk_ms").alias("talk"), F.col("talk_ms").alias("w"), F.col("first_ms").alias("first"))
                 .join(floors, by))
    place = live.select(*by, "speaker", F.col("speaker").alias("at"))
    log, step = None, 0
    while not hinted:
        moves = stage(_next_merges(live, near, by))
        if moves.isEmpty():
            break
        step += 1
        now = moves.select(*by, "speaker", "into", "why", F.lit(step).alias("step"))
        log = now if log is None else log.unionByName(now)
        place = stage(place.join(moves.select(*by, F.col("speaker").alias("at"), "into"), [*by, "at"], "left").select(*by, "speaker", F.coalesce("into", "at").alias("at")))
        live = stage(_merged(live, moves, by))
        near = stage(_renamed(near, moves, by))
    w = Window.partitionBy(*by).orderBy("first", "no")
    final = live.select(*by, F.col("speaker").alias("at"), F.concat(F.lit("S"), F.row_number().over(w)).alias("final_speaker"))
    out = place.join(final, [*by, "at"]).drop("at")
    if log is None:
        return out.select(*by, "speaker", "final_speaker", F.lit(None).cast("string").alias("into"), F.lit(None).cast("string").alias("why"), F.lit(None).cast("int").alias("step"))
    return out.join(log, [*by, "speaker"], "left").select(*by, "speaker", "final_speaker", "into", "why", "step")


def _next_merges(live: DataFrame, near: DataFrame, by: list[str]) -> DataFrame:
    """At most one merge a recording: (by, speaker, into, why). The least talkative speaker under the floor goes to the voice most
    like its own, or else the speaker most next to it, or else the most talkative; without one, the two most alike voices merge."""
    several = live.join(live.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), by)
    small = several.filter("talk < floor").groupBy(*by).agg(F.min_by(F.struct("speaker", "no", "c"), F.struct("talk", "no")).alias("a"))
    b = several.select(*by, F.col("speaker").alias("into"), F.col("no").alias("b_no"), F.col("c").alias("b_c"), F.col("talk").alias("b_talk"))
    beside = near.select(*by, F.col("speaker").alias("from"), F.col("other").alias("into"), "ms")
    pair = small.join(b, by).filter("into <> a.speaker").withColumn("from", F.col("a.speaker")).join(beside, [*by, "from", "into"], "left")
    rank = (F.when(F.col("a.c").isNotNull() & F.col("b_c").isNotNull(), F.struct(F.lit(2).alias("kind"), dot("a.c", "b_c").alias("v")))
            .when(F.col("ms").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("ms").cast("double").alias("v"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("b_talk").cast("double").alias("v"))))
    first = pair.groupBy(*by).agg(F.max_by(F.struct(F.col("a.speaker").alias("speaker"), "into"), F.struct(rank, -F.col("b_no"))).alias("m")).select(*by, "m.speaker", "m.into", F.lit("talk").alias("why"))
    x = several.filter("c is not null").join(small.select(*by), by, "left_anti")
    y = x.select(*by, F.col("speaker").alias("s2"), F.col("no").alias("no2"), F.col("c").alias("c2"), F.col("talk").alias("talk2"))
    two = x.join(y, by).filter("no < no2").withColumn("cos", dot("c", "c2")).filter(F.col("cos") >= SAME_COS)
    goes = F.when((F.col("talk") < F.col("talk2")), F.struct(F.col("speaker"), F.col("s2").alias("into"))).otherwise(F.struct(F.col("s2").alias("speaker"), F.col("speaker").alias("into")))
    second = two.groupBy(*by).agg(F.max_by(goes, F.struct("cos", -F.col("no"), -F.col("no2"))).alias("m")).select(*by, "m.speaker", "m.into", F.lit("same").alias("why"))
    return first.unionByName(second)


def _merged(live: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """The speakers left, each with the voice, talk and first speech of what it took in."""
    gone = moves.join(live.select(*by, "speaker", F.col("c").alias("c2"), F.col("w").alias("w2"), F.col("talk").alias("talk2"), F.col("first").alias("first2")), [*by, "speaker"]).select(
        *by, F.col("into").alias("speaker"), "c2", F.greatest(F.col("w2"), F.lit(linking.MIN_WEIGHT_MS)).alias("w2"), "talk2", "first2")
    left = live.join(moves.select(*by, "speaker"), [*by, "speaker"], "left_anti").join(gone, [*by, "speaker"], "left")
    mean = unit_vector(F.zip_with("c", "c2", lambda p, q: p * F.col("w") + q * F.col("w2")))
    keep, both = F.col("c2").isNull(), mean.isNotNull() & (F.col("w") > 0)
    return left.select(*by, "speaker", "no", F.when(keep, F.col("c")).when(both, mean).otherwise(F.col("c2")).alias("c"), (F.col("talk") + F.coalesce("talk2", F.lit(0))).alias("talk"),
                       F.when(keep, F.col("w")).when(both, F.col("w") + F.col("w2")).otherwise(F.col("w2")).alias("w"), F.least("first", "first2").alias("first"), "floor")


def _renamed(near: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """Adjacent speech with merged speakers under their new names."""
    m = moves.select(*by, F.col("speaker").alias("__a"), F.col("into").alias("__b"))
    for c in ("speaker", "other"):
        near = near.join(m.withColumnRenamed("__a", c), [*by, c], "left").withColumn(c, F.coalesce("__b", c)).drop("__b")
    return near.filter("speaker <> other").groupBy(*by, "speaker", "other").agg(F.sum("ms").alias("ms"))


def match_ids(previous: DataFrame, current: DataFrame, by: list[str] = M) -> DataFrame:
    """Ids for a re-run's speakers so the same people keep theirs: (by, speaker, new_speaker). One to one, the assignment that
    shares most speech, only among pairs that share any; ties to the earlier speaker and the lower id; a speaker left over
    takes the next id nobody had. Both: (by, speaker, start_ms, end_ms) exclusive turns."""
    j = overlap_join(current.select(*by, "speaker", "start_ms", "end_ms"), previous.select(*by, "speaker", "start_ms", "end_ms"), by)
    shared = (j.groupBy(*by, "speaker", "b_speaker").agg(F.sum("overlap_ms").alias("ms")).groupBy(*by, "speaker")
              .agg(F.collect_list(F.struct(F.col("b_speaker").alias("old"), "ms")).alias("shared")))
    olds = previous.select(*by, "speaker").distinct().groupBy(*by).agg(F.collect_list("speaker").alias("olds"))
    cur = current.groupBy(*by, "speaker").agg(F.min("start_ms").alias("first_ms"))
    rows = cur.join(shared, [*by, "speaker"], "left").join(olds, by, "left")
    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by), "speaker string, new_speaker string"])
    return rows.groupBy(*by).applyInPandas(lambda pdf: linking.keep_ids(pdf, by), out)


def talk_stats(turns: DataFrame, by: list[str] = M) -> DataFrame:
    """Per speaker: talk_ms, share, first_ms, turns."""
    g = turns.groupBy(*by, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"), F.min("start_ms").alias("first_ms"),
                                          F.count("*").alias("turns"))
    t = F.sum("talk_ms").over(Window.partitionBy(*by))  # over one row per speaker
    return g.withColumn("share", F.when(t > 0, F.col("talk_ms") / t).otherwise(0.0))


def _clear_of_others(spans: DataFrame, others: DataFrame, key: list[str], by: list[str], guard_ms: int) -> DataFrame:
    """Spans cut ``guard_ms`` clear of every turn of another speaker; ``key`` identifies a span."""
    wide = others.select(*by, "speaker", (F.col("start_ms") - guard_ms).alias("start_ms"), (F.col("end_ms") + guard_ms).alias("end_ms"))
    cut = (overlap_join(spans.select(*key, "start_ms", "end_ms"), wide, by).filter("speaker is distinct from b_speaker")
           .select(*key, F.col("b_start_ms").alias("start_ms"), F.col("b_end_ms").alias("end_ms")))
    return interval_subtract(spans, cut, key)


def _rated(spans: DataFrame, others: DataFrame, turns: DataFrame, by: list[str]) -> DataFrame:
    """Spans with ``iso_ms``, the distance to the nearest turn of another speaker (at most 2 s), and ``voiced_ms``, the
    speaker's own exclusive speech inside."""
    spans = stage(spans)
    key = [*by, "speaker", "start_ms", "end_ms"]
    own = spans.select(*key).distinct()
    wide = own.select(*by, "speaker", F.col("start_ms").alias("__a"), F.col("end_ms").alias("__z"), (F.col("start_ms") - ISOLATION_CAP_MS).alias("start_ms"),
                      (F.col("end_ms") + ISOLATION_CAP_MS).alias("end_ms"))
    d = F.greatest(F.col("b_start_ms") - F.col("__z"), F.col("__a") - F.col("b_end_ms"), F.lit(0))
    near = (overlap_join(wide, others.select(*by, "speaker", "start_ms", "end_ms"), by).filter("speaker is distinct from b_speaker")
            .groupBy(*by, "speaker", F.col("__a").alias("start_ms"), F.col("__z").alias("end_ms")).agg(F.min(d).alias("__d")))
    v = overlap_join(own, turns.select(*by, "speaker", "start_ms", "end_ms"), [*by, "speaker"]).groupBy(*key).agg(F.sum("overlap_ms").alias("__v"))
    x = spans.join(near, key, "left").join(v, key, "left")
    return x.withColumns({"iso_ms": F.least(F.coalesce("__d", F.lit(ISOLATION_CAP_MS)), F.lit(ISOLATION_CAP_MS)), "voiced_ms": F.coalesce("__v", F.lit(0))}).drop("__d", "__v")


def _score(ms: Column, sat: int) -> Column:
    """Up to 1 for length, saturating, plus up to 0.3 for isolation; computed on a whole-number scale."""
    return (10 * F.least(ms, F.lit(sat)) * ISOLATION_CAP_MS + 3 * F.col("iso_ms") * sat) / (10.0 * sat * ISOLATION_CAP_MS)


def _early_late(df: DataFrame, avoid_ms: int | None) -> DataFrame:
    """Spans split at ``avoid_ms`` with ``late`` (0: after it, 1: before it); all late without one."""
    if avoid_ms is None:
        return df.withColumn("late", F.lit(0))
    parts = F.array(F.struct(F.col("start_ms").alias("s"), F.least(F.col("end_ms"), F.lit(avoid_ms)).alias("e"), F.lit(1).alias("l")),
                    F.struct(F.greatest(F.col("start_ms"), F.lit(avoid_ms)).alias("s"), F.col("end_ms").alias("e"), F.lit(0).alias("l")))
    x = df.withColumn("__p", F.explode(F.filter(parts, lambda p: p["s"] < p["e"])))
    return x.withColumns({"start_ms": F.col("__p.s"), "end_ms": F.col("__p.e"), "late": F.col("__p.l")}).drop("__p")


def reference_clips(turns: DataFrame, others: DataFrame | None = None, by: list[str] = M, target_ms: int = 10_000, min_ms: int = 2_000,
                    guard_ms: int = GUARD_MS, avoid_ms: int | None = 60_000, max_ms: int = 12_000) -> DataFrame:
    """Best clips of each speaker, best first, until ``target_ms`` is reached: (by, speaker, rank, start_ms, end_ms). A clip lies
    in one exclusive turn, trimmed by the guard and kept clear of other speakers (``others``: every turn, crosstalk
    included); clips after ``avoid_ms`` come first."""
    others = turns if others is None else others
    t = turns.select(*by, "speaker", "start_ms", "end_ms").filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
    t = t.withColumns({"__t": F.col("start_ms"), "start_ms": F.col("start_ms") + guard_ms, "end_ms": F.col("end_ms") - guard_ms})
    x = _clear_of_others(t, others, [*by, "speaker", "__t"], by, guard_ms).drop("__t")
    x = interval_split(_early_late(x, avoid_ms), max_ms).drop("piece").filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
    x = _rated(x, others, turns, by).withColumn("score", _score(F.col("end_ms") - F.col("start_ms"), LENGTH_SAT_MS))
    w = Window.partitionBy(*by, "speaker").orderBy("late", F.desc("score"), "start_ms", "end_ms")
    most = -(-target_ms // min_ms)  # every clip lasts min_ms, so no more can be taken: the ranking keeps only these
    x = x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    before = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("__b", before).filter(F.col("__b") < target_ms).select(*by, "speaker", "rank", "start_ms", "end_ms", "score")


def clean_stretches(turns: DataFrame, blocks: DataFrame, others: DataFrame | None = None, by: list[str] = M, guard_ms: int = GUARD_MS) -> DataFrame:
    """Contiguous speech of each speaker: own turns joined over diarized pauses of up to 0.6 s, cut clear of other speakers, with
    the pauses' midpoints inside: (by, speaker, start_ms, end_ms, pauses)."""
    others = turns if others is None else others
    k = [*by, "speaker"]
    x = stage(scan(turns.select(*k, "start_ms", "end_ms"), k, ["start_ms", "end_ms"], bucket_of("start_ms", CHUNK), __top=running_max("end_ms")))
    gap = x.select(*k, F.col("__top").alias("__a"), F.col("start_ms").alias("__s"), "end_ms").filter((F.col("__s") > F.col("__a")) & (F.col("__s") - F.col("__a") <= BRIDGE_MS))
    ok = is_covered(gap.select(*by, "speaker", F.col("__a").alias("start_ms"), F.col("__s").alias("end_ms")), coverage(blocks, by), ["speaker", "end_ms"], by)
    ok = ok.filter("covered").select(*k, F.col("end_ms").alias("start_ms")).distinct().withColumn("__ok", F.lit(True))
    x = x.join(ok, [*k, "start_ms"], "left")
    joined = F.col("__top").isNotNull() & ((F.col("start_ms") <= F.col("__top")) | F.coalesce("__ok", F.lit(False)))
    mid = F.when(joined & (F.col("start_ms") > F.col("__top")), F.expr("(__top + start_ms) div 2"))
    x = stage(scan(stage(x.withColumns({"__new": F.when(joined, 0).otherwise(1), "__mid": mid})), k, ["start_ms", "end_ms"], bucket_of("start_ms", CHUNK),
                   __run=running_sum("__new")))
    runs = x.groupBy(*k, "__run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    pauses = x.filter("__mid is not null").select(*k, "__run", "__mid")
    free = stage(_clear_of_others(runs, others, [*k, "__run"], by, guard_ms))
    hit = (free.join(pauses, [*k, "__run"]).filter((F.col("__mid") > F.col("start_ms")) & (F.col("__mid") < F.col("end_ms")))
           .groupBy(*k, "start_ms", "end_ms").agg(F.sort_array(F.collect_list("__mid")).alias("pauses")))
    return (free.drop("__run").join(hit, [*k, "start_ms", "end_ms"], "left")
            .withColumn("pauses", F.coalesce("pauses", F.expr("cast(array() as array<bigint>)"))))


def span_candidates(stretches: DataFrame, turns: DataFrame, others: DataFrame, by: list[str] = M, length_ms: int = 10_000, min_ms: int = 6_000,
                    avoid_ms: int | None = None) -> DataFrame:
    """Candidate windows of the stretches with their ``score`` (seconds voiced, saturating, and isolation)."""
    size_min = min(min_ms, length_ms)
    x = _early_late(stretches, avoid_ms).filter(F.col("end_ms") - F.col("start_ms") >= size_min)
    x = candidate_windows(x, length_ms, size_min, "pauses").select(*by, "speaker", "late", "start_ms", "end_ms")
    x = _rated(x, others, turns, by)
    return x.withColumn("score", F.round(_score(F.col("voiced_ms"), length_ms), 6))


def best_span(candidates: DataFrame, by: list[str] = M, score_col: str | None = None) -> DataFrame:
    """The best single span of each speaker from ``span_candidates``: late ones first, highest score, earliest.

    With ``score_col`` (a caller's score; NULL, NaN or infinite rejects) it is added within a batch of eight: the best
    candidates, or where more than eight are near-ties, eight spread over time; a further batch only for speakers whose
    whole batch was rejected. Each round of batches is one distributed pass over the speakers still open."""
    k = [*by, "speaker"]
    if score_col is None:
        return candidates.groupBy(*k).agg(F.min_by(F.struct("start_ms", "end_ms", "score"), F.struct(F.col("late"), -F.col("score"), F.col("start_ms"), F.col("end_ms"))).alias("b")
                                          ).select(*k, "b.start_ms", "b.end_ms", "b.score")
    e = F.col(score_col).cast("double")
    ok = e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    rest = candidates.withColumns({"__ok": ok, "__total": F.when(ok, F.round(F.col("score") + e, 6))})
    # Pools none of whose candidates is accepted can give nothing; the early pool counts only when the late one gives nothing.
    alive = rest.filter("__ok").groupBy(*k).agg(F.min("late").alias("__pool"))
    rest = stage(rest.join(alive, k).filter(F.col("late") == F.col("__pool")).drop("__pool"))
    done = None
    while True:
        top = rest.groupBy(*k).agg(F.max("score").alias("__top"))
        x = rest.join(top, k).withColumn("__tier", F.col("score") >= F.col("__top") - SCORE_TIE)
        x = scan(x, k, ["start_ms", "end_ms"], bucket_of("start_ms", CHUNK), __i=running_sum(F.when(F.col("__tier"), 1).otherwise(0)))
        n = x.groupBy(*k).agg(F.max("__i").alias("__n"))
        spread = F.expr(f"exists(sequence(0, {SCORE_TOP - 1}), i -> (2 * i + 1) * __n div {2 * SCORE_TOP} + 1 = __i)")
        x = x.join(n, k)
        wide = x.filter((F.col("__n") > SCORE_TOP) & F.col("__tier") & spread)
        w = Window.partitionBy(*k).orderBy(F.desc("score"), "start_ms", "end_ms")
        few = x.filter(F.col("__n") <= SCORE_TOP).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= SCORE_TOP).drop("__r")
        batch = stage(wide.unionByName(few).select(*k, "start_ms", "end_ms", "score", "__ok", "__total"))
        got = batch.filter("__ok").groupBy(*k).agg(F.min_by(F.struct("start_ms", "end_ms", "score"), F.struct(-F.col("__total"), -F.col("score"), F.col("start_ms"))).alias("b"))
        got = got.select(*k, "b.start_ms", "b.end_ms", "b.score")
        done = got if done is None else done.unionByName(got)
        rest = stage(rest.join(got.select(*k), k, "left_anti").join(batch.select(*k, "start_ms", "end_ms"), [*k, "start_ms", "end_ms"], "left_anti"))
        if rest.isEmpty():
            return done


def clean_clips(stretches: DataFrame, turns: DataFrame, others: DataFrame, by: list[str] = M, total_ms: int = 60_000, min_ms: int = 2_000,
                avoid_ms: int | None = None) -> DataFrame:
    """Clean clips of each speaker, best first, ``total_ms`` in all at most; the last is trimmed about its middle when at least
    ``min_ms`` of room is left: (by, speaker, rank, start_ms, end_ms)."""
    x = interval_split(_early_late(stretches.drop("pauses"), avoid_ms), CLEAN_MAX_MS).drop("piece").filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
    x = _rated(x, others, turns, by).withColumn("score", F.round(_score(F.col("voiced_ms"), LENGTH_SAT_MS), 6))
    w = Window.partitionBy(*by, "speaker").orderBy("late", F.desc("score"), "start_ms", "end_ms")
    x = x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= -(-total_ms // min_ms))
    room = total_ms - F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("__room", room).filter(F.col("__room") >= min_ms)
    long = F.col("end_ms") - F.col("start_ms") > F.col("__room")
    a = F.when(long, F.expr("(start_ms + end_ms - __room) div 2")).otherwise(F.col("start_ms"))
    return x.select(*by, "speaker", "rank", a.alias("start_ms"), F.when(long, a + F.col("__room")).otherwise(F.col("end_ms")).alias("end_ms"), "score")


def voice_still_owned(spans: DataFrame, stored: DataFrame, turns: DataFrame, by: list[str] = M, keep: float = 0.9) -> DataFrame:
    """Whether the speech a voice was built from is still its speaker's: (by, speaker, own_ms, speech_ms, valid).
    ``stored(by, speaker, speech_ms)``."""
    k = [*by, "speaker"]
    own = overlap_join(interval_union(spans, k), turns.select(*k, "start_ms", "end_ms"), k).groupBy(*k).agg(F.sum("overlap_ms").alias("own_ms"))
    x = stored.join(own, k, "left").na.fill(0, ["own_ms"])
    return x.select(*k, "own_ms", "speech_ms", (F.col("own_ms") >= keep * F.col("speech_ms")).alias("valid"))


def pitch_vote(frames: DataFrame, key: list[str] = ["media_id", "speaker"], frame_ms: int = 10, min_voiced_ms: int = 2_000,
               min_periodic: float = 0.2, share: float = 0.8) -> DataFrame:
    """Vocal-range vote from pitch rows: (key, range, median_hz): at least 2 s of periodic frames and 20 % of them all, then male
    (female) when 80 % of the pitches lie in 70-160 (190-350) Hz. ``frames(key, hz)``; hz NULL where not periodic."""
    hz = F.col("hz")
    g = frames.groupBy(*key).agg(F.count("*").alias("n"), F.count(hz).alias("p"), F.count_if(hz.between(70, 160)).alias("low"),
                                 F.count_if(hz.between(190, 350)).alias("high"))
    g = g.join(quantiles(frames, key, {"hz": (hz, {"median_hz": 0.5})}), key, "left")
    enough = (F.col("p") * frame_ms >= min_voiced_ms) & (F.col("p") >= min_periodic * F.col("n"))
    r = (F.when(enough & (F.col("low") >= share * F.col("p")), "male").when(enough & (F.col("high") >= share * F.col("p")), "female").otherwise("unresolved"))
    return g.select(*key, r.alias("range"), "median_hz")


def speakers_report(turns: DataFrame, durations: DataFrame, merges: DataFrame | None = None, by: list[str] = M, bins: int = 120) -> DataFrame:
    """Who was found: talk statistics, the activity strip as an array of ``bins`` shares, and the ids merged into each."""
    a = activity(turns, durations, bins, by).groupBy(*by, "speaker").agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("m"))
    a = a.select(*by, "speaker", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("activity"))
    x = talk_stats(turns, by).join(a, [*by, "speaker"], "left")
    if merges is not None:
        m = merges.groupBy(*by, F.col("into").alias("speaker")).agg(F.sort_array(F.collect_list("from")).alias("merged"))
        x = x.join(m, [*by, "speaker"], "left")
    return x
