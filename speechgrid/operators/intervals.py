"""Interval algebra over half-open millisecond spans.

All operators work per ``by`` (normally ``["media_id"]`` plus optional group columns). Long recordings are cut into time
buckets: a bucket is solved on its own, and only what touches a bucket edge is stitched across buckets, so no task ever
holds a whole recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import last_seen, scan
from ..functions.spans import bucket_of, buckets, overlap_join, point_join
from ..session import stage

UNION_BUCKET_MS = 600_000
MIN_PIECE_MS = 20
NEAR_MS = 500
DASH = "– "


def _islands(df: DataFrame, keys: list[str], join: Column) -> DataFrame:
    """The islands inside each ``keys`` group: (keys, start_ms, end_ms, and ``__left`` of the first row where there is one); ``join``
    says whether a row (start_ms) continues the running ``__top`` (largest end so far). An island's end is the top before the next
    island, so one sort and two windows in its order do, and no table of islands is held."""
    left = ["__left"] if "__left" in df.columns else []
    w = Window.partitionBy(*keys).orderBy("start_ms", *[F.col(c).desc() for c in left], "end_ms")
    x = df.withColumns({"__top": F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                        "__end": F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    x = x.filter(F.col("__top").isNull() | ~join)
    return x.select(*keys, "start_ms", F.coalesce(F.lead("__top").over(w), "__end").alias("end_ms"), *left)


def _join_rule(touch: bool, bridge_ms: int, slack_ms: int) -> Column:
    s, top = F.col("start_ms"), F.col("__top")
    if touch or slack_ms:
        return s <= top + bridge_ms + slack_ms
    return s < top + bridge_ms


def interval_union(df: DataFrame, by: list[str], touch: bool = True, bridge_ms: int = 0, slack_ms: int = 0,
                   bucket_ms: int | None = UNION_BUCKET_MS) -> DataFrame:
    """Disjoint islands of the spans: (by, start_ms, end_ms). Empty spans are ignored.

    ``touch``: spans that only touch are joined. ``touch=False`` keeps them apart unless ``bridge_ms`` > 0, which joins
    gaps strictly shorter than it. ``slack_ms`` joins gaps up to and including it. ``bucket_ms=None`` is for groups that
    are small by construction."""
    reach = bridge_ms + slack_ms
    rule = _join_rule(touch, bridge_ms, slack_ms)
    spans = df.filter(F.col("end_ms") > F.col("start_ms")).select(*by, "start_ms", "end_ms")
    if bucket_ms is None:
        return _islands(spans, by, rule)
    w = bucket_ms
    lo, hi = F.col("__b") * w, (F.col("__b") + 1) * w
    cut = (spans.withColumn("__b", F.explode(buckets(F.col("start_ms"), F.col("end_ms"), w)))
           .withColumns({"__left": F.col("start_ms") < lo,
                         "start_ms": F.greatest(F.col("start_ms"), lo), "end_ms": F.least(F.col("end_ms"), hi)}))
    return _stitch(_islands(cut, [*by, "__b"], rule), by, lo, hi, reach, rule)


def _stitch(pieces: DataFrame, by: list[str], lo: Column, hi: Column, reach: int, rule: Column) -> DataFrame:
    """Join pieces across bucket edges. Pieces away from the edges stay in their bucket's group; those within ``reach``
    of an edge (at most two a bucket) meet in one group per ``by``. A piece that may go on from the left (``__left``) does so only
    where the piece before reaches its start."""
    edge = (F.col("start_ms") <= lo + reach) | (F.col("end_ms") >= hi - reach)
    x = pieces.withColumn("__g", F.when(edge, F.lit(-1).cast("bigint")).otherwise(F.col("__b")))
    goes_on = F.col("__left") & (F.col("__top") >= F.col("start_ms"))
    return _islands(x, [*by, "__g"], rule | goes_on).select(*by, "start_ms", "end_ms")


def join_turns(turns: DataFrame, by: list[str] = ["media_id"], slack_ms: int = 1, **kw) -> DataFrame:
    """Each speaker's turns with pieces up to ``slack_ms`` apart joined; other speakers in between do not break one."""
    return interval_union(turns, [*by, "speaker"], slack_ms=slack_ms, **kw)


def coverage(blocks: DataFrame, by: list[str] = ["media_id"], slack_ms: int = 1) -> DataFrame:
    """Diarized stretches: the union of the blocks with 1 ms of slack."""
    return interval_union(blocks, by, slack_ms=slack_ms)


def interval_length(df: DataFrame, by: list[str], **kw) -> DataFrame:
    """Milliseconds covered by the union: (by, length_ms)."""
    return (interval_union(df, by, **kw).groupBy(*by)
            .agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("length_ms")))


def interval_overlap(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Overlap rows of two span tables, clipped to the shared part (start_ms, end_ms); columns of ``b`` are prefixed."""
    j = overlap_join(a, b, on)
    return j.withColumns({"start_ms": F.greatest("start_ms", "b_start_ms"), "end_ms": F.least("end_ms", "b_end_ms")})


def shared_length(a: DataFrame, b: DataFrame, by: list[str], **kw) -> DataFrame:
    """Milliseconds shared by the two unions: (by, shared_ms), for keys where any is shared."""
    return (overlap_join(interval_union(a, by, **kw), interval_union(b, by, **kw), by)
            .groupBy(*by).agg(F.sum("overlap_ms").alias("shared_ms")))


def interval_subtract(a: DataFrame, b: DataFrame, by: list[str], min_ms: int = 0,
                      bucket_ms: int = UNION_BUCKET_MS) -> DataFrame:
    """The parts of ``a``'s rows outside ``b``: every column of ``a`` with start_ms/end_ms set to the part. Parts must be
    longer than ``min_ms``. ``a`` rows must be distinct (give them an id column).

    Within each bucket ``b`` is a short list of disjoint spans, so a piece of an ``a`` row is cut with array functions;
    parts that meet at a bucket edge are stitched."""
    w = bucket_ms
    lo, hi = F.col("__b") * w, (F.col("__b") + 1) * w
    cover = (interval_union(b, by, bucket_ms=w)
             .withColumn("__b", F.explode(buckets(F.col("start_ms"), F.col("end_ms"), w)))
             .groupBy(*by, "__b")
             .agg(F.sort_array(F.collect_list(F.struct(F.greatest("start_ms", lo).alias("s"),
                                                       F.least("end_ms", hi).alias("e")))).alias("__cover")))
    x = (a.filter(F.col("end_ms") > F.col("start_ms"))
         .withColumns({"__s": F.col("start_ms"), "__e": F.col("end_ms"),
                       "__b": F.explode(buckets(F.col("start_ms"), F.col("end_ms"), w))})
         .withColumns({"__left": F.col("__s") < lo, "__s": F.greatest("__s", lo), "__e": F.least("__e", hi)})
         .join(cover, [*by, "__b"], "left"))
    x = x.withColumn("__part", F.explode(F.expr(
        "filter(transform(sequence(0, size(coalesce(__cover, array()))), i -> struct("
        "  greatest(__s, if(i = 0, __s, get(__cover, i - 1).e)) as s,"
        "  least(__e, if(i = size(coalesce(__cover, array())), __e, get(__cover, i).s)) as e)), p -> p.s < p.e)")))
    ident = [c for c in a.columns if c not in ("start_ms", "end_ms")]
    span = [F.col("start_ms").alias("__os"), F.col("end_ms").alias("__oe")]
    parts = x.select(*ident, *span, "__b", (F.col("__left") & (F.col("__part.s") == lo)).alias("__left"),
                     F.col("__part.s").alias("start_ms"), F.col("__part.e").alias("end_ms"))
    keys = [*ident, "__os", "__oe"]
    out = _stitch(parts, keys, lo, hi, 0, F.lit(False))
    return out.filter(F.col("end_ms") - F.col("start_ms") > min_ms).select(*a.columns)


def interval_gaps(windows: DataFrame, cover: DataFrame, by: list[str], min_ms: int = 0) -> DataFrame:
    """Parts of each window no span of ``cover`` touches, longer than ``min_ms``."""
    return interval_subtract(windows, cover, by, min_ms)


def interval_clip(df: DataFrame, windows: DataFrame, on: list[str], min_ms: int = 0) -> DataFrame:
    """Rows of ``df`` clipped to each window they meet; pieces shorter than ``min_ms`` are left out."""
    j = overlap_join(df, windows.select(*on, "start_ms", "end_ms"), on)
    return (j.withColumns({"start_ms": F.greatest("start_ms", "b_start_ms"), "end_ms": F.least("end_ms", "b_end_ms")})
            .filter(F.col("end_ms") - F.col("start_ms") >= min_ms).select(*df.columns))


def elementary_pieces(df: DataFrame, by: list[str], bucket_ms: int = UNION_BUCKET_MS) -> DataFrame:
    """Cut the time line at every edge of ``df`` (and at bucket edges) and attach the rows alive in each piece:
    (by, __b, p_start, p_end, and ``df``'s own columns)."""
    w = bucket_ms
    lo, hi = F.col("__b") * w, (F.col("__b") + 1) * w
    x = (df.filter(F.col("end_ms") > F.col("start_ms"))
         .withColumn("__b", F.explode(buckets(F.col("start_ms"), F.col("end_ms"), w))))
    edges = (x.select(*by, "__b", F.explode(F.array(F.greatest("start_ms", lo), F.least("end_ms", hi))).alias("p_start"))
             .distinct()
             .withColumn("p_end", F.lead("p_start").over(Window.partitionBy(*by, "__b").orderBy("p_start")))
             .filter("p_end is not null"))
    # A second, finer equi key (one of 64 slices of the bucket) keeps a crowded bucket from pairing every edge with every row.
    f = max(w // 64, 1)
    ex = edges.withColumn("__f", bucket_of("p_start", f))
    rx = x.withColumn("__f", F.explode(buckets(F.greatest("start_ms", lo), F.least("end_ms", hi), f)))
    return (rx.join(ex, [*by, "__b", "__f"])
            .filter((F.col("start_ms") <= F.col("p_start")) & (F.col("p_start") < F.col("end_ms"))).drop("__f"))


def exclusive_turns(turns: DataFrame, by: list[str] = ["media_id"], bucket_ms: int = UNION_BUCKET_MS) -> DataFrame:
    """One speaker at a time: where turns overlap the longest wins, the earlier start on a tie (then the lower name).
    Touching pieces of one speaker are joined."""
    pieces = elementary_pieces(turns.select(*by, "speaker", "start_ms", "end_ms"), by, bucket_ms)
    best = (pieces.groupBy(*by, "__b", "p_start", "p_end")
            .agg(F.min_by("speaker", F.struct(F.col("start_ms") - F.col("end_ms"), F.col("start_ms"),
                                              F.col("speaker"))).alias("speaker")))
    return interval_union(best.select(*by, "speaker", F.col("p_start").alias("start_ms"), F.col("p_end").alias("end_ms")),
                          [*by, "speaker"], bucket_ms=bucket_ms)


def nearest_turn(points: DataFrame, turns: DataFrame, at: str, key: list[str], by: list[str] = ["media_id"],
                 near_ms: int = NEAR_MS, mode: str = "registry", chunk_ms: int = UNION_BUCKET_MS) -> DataFrame:
    """``points`` with a ``speaker`` column. ``key`` orders and identifies points inside ``by``.

    ``mode="registry"``: turns are exclusive; the one containing the time (start closed, end open), else the nearest
    within ``near_ms`` (ties: containing, same as the previous point's, later start), else the previous point's, else
    the most talkative (lower name on a tie), else "S1".
    ``mode="segmenter"``: the longest containing turn (both ends closed), else the nearest within ``near_ms``, else the
    previous point's, else the nearest at any distance, else "S1"; ties go to the previous point's speaker, then the
    earlier start.
    The previous point's speaker is the one it was given, whether by a tie or not."""
    t = F.col(at)
    j = point_join(points, turns.select(*by, "speaker", "start_ms", "end_ms"), by, at, near_ms)
    d = F.greatest(F.col("b_start_ms") - t, t - F.col("b_end_ms"), F.lit(0))
    if mode == "registry":
        inside = (F.col("b_start_ms") <= t) & (t < F.col("b_end_ms"))
        rank, tail = F.struct(d, ~inside), -F.col("b_start_ms")
    else:
        inside = (F.col("b_start_ms") <= t) & (t <= F.col("b_end_ms"))
        rank = F.struct(F.when(inside, F.col("b_start_ms") - F.col("b_end_ms")).otherwise(F.lit(1).cast("bigint")), d)
        tail = F.col("b_start_ms")
    # First the best row of each speaker near a point, then the speakers sharing the best rank: one shuffle by point.
    near = (j.select(*by, *key, F.col("b_speaker").alias("spk"), rank.alias("rank"), tail.alias("tail"))
            .groupBy(*by, *key, "spk").agg(F.min(F.struct("rank", "tail")).alias("m")))
    cand = near.groupBy(*by, *key).agg(F.min("m.rank").alias("__r"), F.collect_list(F.struct(F.col("m.rank").alias("rank"), F.col("m.tail").alias("tail"), "spk")).alias("__c"))
    tied = cand.withColumn("__c", F.array_sort(F.filter("__c", lambda c: c["rank"] == F.col("__r")))).select(
        *by, *key, F.expr("__c[0].spk").alias("__pick"), F.transform("__c", lambda c: c["spk"]).alias("__tied"))
    if mode == "registry":
        talk = turns.groupBy(*by, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
        start = talk.groupBy(*by).agg(F.min_by("speaker", F.struct(-F.col("ms"), F.col("speaker"))).alias("__start"))
    else:
        # Only a recording's leading points can lack a speaker; they take the turn nearest to the first of them.
        t0 = points.groupBy(*by).agg(F.min(at).alias("__t0"))
        far = F.greatest(F.col("start_ms") - F.col("__t0"), F.col("__t0") - F.col("end_ms"))
        start = turns.join(t0, by).groupBy(*by).agg(F.min_by("speaker", F.struct(far, F.col("start_ms"), F.col("speaker"))).alias("__start"))
    x = points.join(tied, [*by, *key], "left").join(start, by, "left").withColumn("__start", F.coalesce("__start", F.lit("S1")))
    return _carry_ties(x, points.columns, at, key, by, chunk_ms)


def _carry_ties(x: DataFrame, columns: list[str], at: str, key: list[str], by: list[str], chunk_ms: int) -> DataFrame:
    """``columns`` and ``speaker``: of a point's tied speakers the one of the point before, else its pick; without any, that of the
    point before (the first: ``__start``).

    Neighbouring points with the same tied speakers (or none) are a run: they all get what its first point gets, so a chunk keeps one
    row a run in its array, and no array grows with the points. A chunk is summarised by the speaker it ends with for each speaker it
    may be entered with; the summaries are followed in order, and every chunk then labels its own runs."""
    w = Window.partitionBy(*by, "__c").orderBy(at, *key)
    x = x.withColumn("__c", bucket_of(at, chunk_ms))
    same = F.lag("__tied").over(w).eqNullSafe(F.col("__tied")) & (F.row_number().over(w) > 1)
    x = x.withColumn("__new", (~same).cast("int")).withColumn("__run", F.sum("__new").over(w).cast("int"))
    x = stage(x.select(*columns, "__c", "__run", "__new", "__pick", "__tied", "__start"))
    run = F.struct("__run", F.col("__pick").alias("pick"), F.col("__tied").alias("tied"))
    g = stage(x.filter("__new = 1").groupBy(*by, "__c").agg(F.array_sort(F.collect_list(run)).alias("ps"), F.first("__start").alias("__start")))
    says = "case when p.tied is null then coalesce({0}, __start) when array_contains(p.tied, {0}) then {0} else p.pick end"
    through = f"aggregate(ps, cast({{0}} as string), (e, p) -> {says.format('e')})"
    names = "array_distinct(flatten(transform(filter(ps, p -> p.tied is not null), p -> p.tied)))"
    other = "'\\u0000'"
    maps = g.select(*by, "__c", F.expr(names).alias("n"), "ps", "__start").select(
        *by, "__c", "n", F.expr(f"transform(n, s -> {through.format('s')})").alias("to"), F.expr(through.format(other)).alias("rest"), F.expr(through.format("null")).alias("none"))
    leave = f"case when t.e is null then m.none when array_contains(m.n, t.e) then m.to[array_position(m.n, t.e) - 1] when m.rest = {other} then t.e else m.rest end"
    enter = ("aggregate(ms, struct(cast(array() as array<struct<c:bigint,e:string>>) as o, cast(null as string) as e), (t, m) -> "
             f"struct(concat(t.o, array(struct(cast(m.__c as bigint) as c, t.e as e))) as o, {leave} as e)).o")
    entries = (maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__c", "n", "to", "rest", "none"))).alias("ms"))
               .select(*by, F.explode(F.expr(enter)).alias("x")).select(*by, F.col("x.c").alias("__c"), F.col("x.e").alias("__e")))
    label = ("aggregate(ps, struct(cast(array() as array<string>) as o, __e as e), (t, p) -> get(transform(array("
             f"{says.format('t.e')}), s -> struct(concat(t.o, array(s)) as o, s as e)), 0)).o")
    done = g.join(entries, [*by, "__c"]).select(*by, "__c", F.expr(label).alias("__says"))
    return x.join(done, [*by, "__c"]).select(*columns, F.expr("__says[__run - 1]").alias("speaker"))


def activity(turns: DataFrame, durations: DataFrame, bins: int = 120, by: list[str] = ["media_id"]) -> DataFrame:
    """Share of each of ``bins`` equal slices of [0, duration_ms] covered by a speaker's exclusive speech:
    (by, speaker, bin, share), zero slices left out. The slice width is exact: times are scaled by ``bins``."""
    j = turns.join(durations.filter("duration_ms > 0").select(*by, "duration_ms"), by)
    s = F.greatest(F.col("start_ms"), F.lit(0)) * bins
    e = F.least(F.col("end_ms"), F.col("duration_ms")) * bins
    x = j.select(*by, "speaker", "duration_ms", s.alias("s"), e.alias("e")).filter("e > s")
    x = x.withColumn("bin", F.explode(F.sequence(F.expr("s div duration_ms"), F.expr("(e - 1) div duration_ms"))))
    part = F.least(F.col("e"), (F.col("bin") + 1) * F.col("duration_ms")) - F.greatest(
        F.col("s"), F.col("bin") * F.col("duration_ms"))
    return (x.groupBy(*by, "speaker", "bin", "duration_ms").agg(F.sum(part).alias("ms"))
            .select(*by, "speaker", "bin", (F.col("ms") / F.col("duration_ms")).alias("share")))


def covered_until(points: DataFrame, cover: DataFrame, at: str, key: list[str], by: list[str] = ["media_id"],
                  slack_ms: int = 1) -> DataFrame:
    """End of the contiguous coverage (disjoint islands) containing each point, else the point itself; the earliest
    island wins where the slack lets two match."""
    hit = (point_join(points.select(*by, *key, at), cover, by, at, slack_ms)
           .groupBy(*by, *key).agg(F.min_by("b_end_ms", "b_start_ms").alias("__e")))
    return (points.join(hit, [*by, *key], "left")
            .withColumn("until_ms", F.greatest(F.coalesce("__e", F.col(at)), F.col(at))).drop("__e"))


def is_covered(spans: DataFrame, cover: DataFrame, key: list[str], by: list[str] = ["media_id"],
               slack_ms: int = 1) -> DataFrame:
    """``spans`` with ``covered``: one island holds the whole span, within the slack."""
    hit = (point_join(spans.select(*by, *key, "start_ms", "end_ms"), cover, by, "start_ms", slack_ms)
           .filter(F.col("end_ms") <= F.col("b_end_ms") + slack_ms).select(*by, *key).distinct()
           .withColumn("__hit", F.lit(True)))
    return (spans.join(hit, [*by, *key], "left")
            .withColumn("covered", F.coalesce("__hit", F.lit(False))).drop("__hit"))


def interval_split(df: DataFrame, size_ms: int) -> DataFrame:
    """Each span in the fewest equal pieces no longer than ``size_ms`` (edges on whole milliseconds): adds ``piece``."""
    d = F.col("end_ms") - F.col("start_ms")
    n = F.expr(f"(end_ms - start_ms + {size_ms} - 1) div {size_ms}")
    x = df.filter(d > 0).withColumn("__n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                                       F.col("__n") - 1)))
    return x.withColumns({
        "start_ms": F.expr("start_ms + (end_ms - start_ms) * piece div __n"),
        "end_ms": F.expr("start_ms + (end_ms - start_ms) * (piece + 1) div __n")}).drop("__n")


def candidate_windows(df: DataFrame, size_ms: int, min_ms: int = 0, pauses: str | None = None) -> DataFrame:
    """Windows of each span: itself when it fits ``size_ms``; else, from its start and each pause inside, the longest
    window of min..size ending on a later pause or its end; with none, windows of exactly ``size_ms`` spread evenly.
    ``pauses`` names an ARRAY<BIGINT> column of points."""
    p = f"array_sort(filter({pauses}, p -> p > start_ms and p < end_ms))" if pauses else "array()"
    x = df.withColumn("__edges", F.expr(
        f"concat(array(cast(start_ms as bigint)), cast({p} as array<bigint>), array(cast(end_ms as bigint)))"))
    x = x.withColumn("__snapped", F.expr(
        f"filter(transform(slice(__edges, 1, size(__edges) - 1), s -> struct(s as s, "
        f"array_max(filter(__edges, e -> e > s and e - s <= {size_ms})) as e)), w -> w.e - w.s >= {min_ms})"))
    n = f"greatest(2, (end_ms - start_ms + {size_ms} - 1) div {size_ms})"
    spread = (f"transform(sequence(bigint(0), {n} - 1), i -> struct("
              f"start_ms + i * (end_ms - start_ms - {size_ms}) div ({n} - 1) as s,"
              f"start_ms + i * (end_ms - start_ms - {size_ms}) div ({n} - 1) + {size_ms} as e))")
    x = x.withColumn("__w", F.explode(F.expr(
        f"case when end_ms - start_ms <= {size_ms} then array(struct(cast(start_ms as bigint) as s, cast(end_ms as bigint) as e)) "
        f"when size(__snapped) > 0 then __snapped else {spread} end")))
    return x.select(*[c for c in df.columns if c not in ("start_ms", "end_ms")],
                    F.col("__w.s").alias("start_ms"), F.col("__w.e").alias("end_ms"))


def windows_at_pauses(spans: DataFrame, pauses: DataFrame, size_ms: int, min_ms: int = 0, key: list[str] = ["media_id", "turn"], at: str = "at_ms") -> DataFrame:
    """``candidate_windows`` with the pauses as rows (key, at): (key, start_ms, end_ms). ``key`` names a span, in a recording's time.

    The last edge within ``size_ms`` of each edge comes from one ordered scan over the edges and the edges moved on by the size, so
    the work is linear in the pauses, and a span may hold any number of them: they are cut by time, never gathered."""
    whole = spans.select(*key, F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"))
    long = whole.filter(F.col("end_ms") - F.col("start_ms") > size_ms)
    inside = point_join(pauses.select(*key, F.col(at).cast("bigint").alias("__x")), long, key, "__x").filter((F.col("__x") > F.col("b_start_ms")) & (F.col("__x") < F.col("b_end_ms")))
    edges = stage(inside.select(*key, "__x").unionByName(long.select(*key, F.explode(F.array("start_ms", "end_ms")).alias("__x"))).distinct())
    here = edges.select(*key, F.col("__x").alias("__t"), F.lit(0).alias("__k"), F.col("__x").alias("__e"), F.lit(None).cast("bigint").alias("__s"))
    asks = edges.select(*key, (F.col("__x") + size_ms).alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast("bigint").alias("__e"), F.col("__x").alias("__s"))
    far = scan(here.unionByName(asks), key, ["__t", "__k"], bucket_of("__t", UNION_BUCKET_MS), __far=last_seen("__e")).filter("__k = 1")
    snapped = stage(far.filter((F.col("__far") > F.col("__s")) & (F.col("__far") - F.col("__s") >= min_ms)).select(*key, F.col("__s").alias("start_ms"), F.col("__far").alias("end_ms")))
    n = F.expr(f"greatest(2, (end_ms - start_ms + {size_ms} - 1) div {size_ms})")
    bare = long.join(snapped.select(*key).distinct(), key, "left_anti").withColumn("__n", n).withColumn("__i", F.explode(F.expr("sequence(bigint(0), __n - 1)")))
    first = F.expr(f"start_ms + __i * (end_ms - start_ms - {size_ms}) div (__n - 1)")
    spread = bare.select(*key, first.alias("start_ms"), (first + size_ms).alias("end_ms"))
    return whole.filter(F.col("end_ms") - F.col("start_ms") <= size_ms).unionByName(snapped).unionByName(spread)


def sweep_merge(cues: DataFrame, by: list[str] = ["media_id"], bucket_ms: int = UNION_BUCKET_MS) -> DataFrame:
    """Labelled cues as one track: cut at all edges; a piece's text is one block per speaker, in the order they began
    (each behind a dash when two or more talk); equal touching pieces are joined."""
    p = elementary_pieces(cues.select(*by, "speaker", "start_ms", "end_ms", "text"), by, bucket_ms)
    live = (p.groupBy(*by, "__b", "p_start", "p_end")
            .agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "speaker", "text"))).alias("__live")))
    # One block per speaker, in the order each speaker's first live cue began; several cues of one speaker share it.
    who = "array_distinct(transform(__live, x -> x.speaker))"
    block = ("concat_ws('\n', transform(filter(__live, x -> x.speaker <=> s), x -> x.text))")
    text = (f"if(size({who}) = 1, concat_ws('\n', transform(__live, x -> x.text)),"
            f" concat_ws('\n', transform({who}, s -> concat('{DASH}', {block}))))")
    pieces = live.select(*by, F.col("p_start").alias("start_ms"), F.col("p_end").alias("end_ms"), F.expr(text).alias("text"))
    return interval_union(pieces, [*by, "text"], bucket_ms=bucket_ms)


def rolling_load(events: DataFrame, by: list[str] = ["media_id"], at: str = "t_ms", amount: str = "amount",
                 window_ms: int = 60_000) -> DataFrame:
    """Largest total of event amounts in any window (w - window_ms, w]: (by, peak). Windows ending at events suffice.

    Each event is copied to its own bucket and the next one (bucket width = window), so every window lies in one bucket."""
    x = (events.select(*by, F.col(at).alias("t"), F.col(amount).alias("v"))
         .withColumn("__own", bucket_of("t", window_ms))
         .withColumn("__b", F.explode(F.array("__own", F.col("__own") + 1))))
    w = Window.partitionBy(*by, "__b").orderBy("t").rangeBetween(-(window_ms - 1), 0)
    return (x.withColumn("load", F.sum("v").over(w)).filter(F.col("__b") == F.col("__own"))
            .groupBy(*by).agg(F.max("load").alias("peak")))


def frame_mean(frames: DataFrame, spans: DataFrame, by: list[str], frame_ms: int = 100) -> DataFrame:
    """Mean of the known frame values whose middle lies in a span (each frame once): (by, mean, n). Keys with no known
    frame are absent; join left for NULL."""
    mid = frames.withColumn("__mid", F.col("frame_no") * frame_ms + frame_ms // 2)
    hit = point_join(mid, interval_union(spans, by), by, "__mid").filter(
        (F.col("__mid") >= F.col("b_start_ms")) & (F.col("__mid") < F.col("b_end_ms")))
    return (hit.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
            .groupBy(*by).agg(F.avg("value").alias("mean"), F.count("value").alias("n")))
