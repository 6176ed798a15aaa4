"""Transcript assembly and recognition quality: split numbers, chunk cuts, uncovered speech, doubtful words, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import following, last_seen, leap, next_seen, prev, row_number, running_sum, scan, with_neighbours
from ..functions.spans import bucket_of, overlap_join, point_join
from ..functions.text import let
from ..functions.words import LEXICON, Lexicon, core, sentence_end
from ..session import stage
from .intervals import interval_gaps, interval_union

CHUNK = 600_000

# What may end the left part and start the right part of a split number.
LEFT_CURRENCY = "^[(\\[\"'“‘]*[$₹€£¥]$"
OPENING = "^[(\\[\"'“‘+\\-−~$₹€£¥]*"
NUMBER_PARTS = (
    (OPENING + "(?:\\p{Nd}+|\\p{Nd}{1,3}(?:,\\p{Nd}{2,3})+)$", "^\\.\\p{Nd}"),
    (OPENING + "\\p{Nd}{1,3}(?:,\\p{Nd}{2,3})*$", "^,(?:\\p{Nd}{2},)*\\p{Nd}{3}(?!\\p{Nd})"),
    (OPENING + "\\p{Nd}{1,2}(?::\\p{Nd}{2})?$", "^:\\p{Nd}{2}(?!\\p{Nd})"),
    (OPENING + "\\p{Nd}+(?:[.,]\\p{Nd}+)*$", "^%"),
)
# End of fixed values.


def chunk_of(ms: str = "start_ms") -> Column:
    return bucket_of(ms, CHUNK)


def _joins(left: Column, right: Column) -> Column:
    """``right`` is the split-off rest of the number ``left`` ends with."""
    any_part = F.lit(False)
    for a, b in NUMBER_PARTS:
        any_part = any_part | (F.rlike(right, F.lit(b)) & F.rlike(left, F.lit(a)))
    money = F.rlike(left, F.lit(LEFT_CURRENCY))
    return F.when(money, F.rlike(right, F.lit("^\\p{Nd}"))).otherwise(any_part)


def join_split_numbers(words: DataFrame, by: list[str] = ["media_id"]) -> DataFrame:
    """Numbers the recogniser split ("17" ".72", "$" "5") joined again: (by, idx, word, start_ms, end_ms, conf), the
    first piece's idx and start, the latest end, the lowest confidence. A word can only join one before it when it looks
    like a right part, so the ordered fold runs inside short runs of such words."""
    x = scan(words.select(*by, "idx", "word", "start_ms", "end_ms", "conf"), by, ["idx"], F.expr("idx div 4096"),
             __p=prev("word"))
    right = F.lit(False)
    for _, b in NUMBER_PARTS:
        right = right | F.rlike("word", F.lit(b))
    cand = F.coalesce(right | (F.rlike("__p", F.lit(LEFT_CURRENCY)) & F.rlike("word", F.lit("^\\p{Nd}"))), F.lit(False))
    x = scan(x.withColumn("__head", F.when(~cand | F.col("__p").isNull(), F.col("idx"))), by, ["idx"], F.expr("idx div 4096"),
             __run=last_seen("__head"))
    g = x.groupBy(*by, "__run").agg(F.array_sort(F.collect_list(F.struct("idx", "word", "start_ms", "end_ms", "conf")))
                                    .alias("ws"))

    def step(acc: Column, w: Column) -> Column:
        p = F.element_at(acc, -1)
        joined = F.struct(p["idx"].alias("idx"), F.concat(p["word"], w["word"]).alias("word"),
                          p["start_ms"].alias("start_ms"), F.greatest(p["end_ms"], w["end_ms"]).alias("end_ms"),
                          F.least(p["conf"], w["conf"]).alias("conf"))
        return F.when(_joins(p["word"], w["word"]),
                      F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(w)))

    folded = F.when(F.size("ws") == 1, F.col("ws")).otherwise(
        F.aggregate(F.slice("ws", F.lit(2), F.size("ws")), F.slice("ws", 1, 1), step))
    return g.select(*by, F.inline(folded))


def chunk_cuts(words: DataFrame, by: list[str] = ["media_id"], chunk_ms: int = 60_000, pad_ms: int = 5_000,
               pause_ms: int = 400, lex: Lexicon = LEXICON) -> DataFrame:
    """Sentence-safe chunks (by, chunk_no, a_ms, b_ms). At each nominal boundary the chunk ends after the last sentence end
    before it, else the first within ``pad_ms`` after it that another word follows, else the longest pause over
    ``pause_ms`` before it, else the last word before it; the last chunk ends with the last word.

    Boundaries are nominal (whole multiples of ``chunk_ms``) rather than measured from the cut before, so every boundary
    is decided at once by one aggregation."""
    x = scan(words.select(*by, "idx", "word", "start_ms", "end_ms"), by, ["idx"], chunk_of(),
             __n=following(F.struct("word", "start_ms")), __prev=prev("end_ms"))
    x = x.withColumns({"__send": sentence_end("word", F.col("__n.word"), lex),
                       "k": bucket_of(F.col("end_ms") - 1, chunk_ms)})
    near = F.col("k") * chunk_ms + pad_ms >= F.col("end_ms")
    x = x.withColumn("chunk_no", F.explode(F.filter(F.array(F.col("k"), F.when(near & (F.col("k") > 0), F.col("k") - 1)),
                                                    lambda c: c.isNotNull())))
    b = (F.col("chunk_no") + 1) * chunk_ms
    inside, e = F.col("end_ms") <= b, F.col("end_ms")
    gap = F.col("__n.start_ms") - e
    cuts = x.groupBy(*by, "chunk_no").agg(
        F.max(F.when(inside & F.col("__send"), e)).alias("c1"),
        F.min(F.when(~inside & F.col("__send") & F.col("__n").isNotNull(), e)).alias("c2"),
        F.max_by(e, F.when(inside & (F.col("__n.start_ms") < b) & (gap > pause_ms), F.struct(gap, -e))).alias("c3"),
        F.max(F.when(inside, e)).alias("c4"),
        F.max(F.when(F.col("__n").isNull(), e)).alias("end"))
    cuts = cuts.filter("c4 is not null")
    last = F.col("end").isNotNull() & (F.col("end") <= b)
    cut = F.when(last, F.col("end")).otherwise(F.coalesce("c1", "c2", "c3", "c4"))
    out = stage(cuts.select(*by, "chunk_no", cut.alias("b_ms")))  # one row per chunk
    out = scan(out, by, ["chunk_no"], F.expr("chunk_no div 4096"), a_ms=prev("b_ms"))
    return out.select(*by, "chunk_no", F.coalesce("a_ms", F.lit(0).cast("bigint")).alias("a_ms"), "b_ms")


def own_words(words: DataFrame, chunks: DataFrame, by: list[str] = ["media_id"], slack_ms: int = 50) -> DataFrame:
    """Words with the chunk that owns them: they end by its cut (and after the cut before) and start no more than ``slack_ms``
    before it."""
    c = chunks.select(*by, "chunk_no", F.col("a_ms").alias("start_ms"), F.col("b_ms").alias("end_ms"))
    j = point_join(words, c, by, "end_ms").filter(
        (F.col("end_ms") > F.col("b_start_ms")) & (F.col("start_ms") >= F.col("b_start_ms") - slack_ms))
    return j.select(*words.columns, F.col("b_chunk_no").alias("chunk_no"))


def uncovered_speech(words: DataFrame, turns: DataFrame, by: list[str] = ["media_id"], min_ms: int = 800) -> DataFrame:
    """Diarized speech longer than ``min_ms`` that no word touches: (by, start_ms, end_ms)."""
    return interval_gaps(interval_union(turns, by), words, by, min_ms)


def low_confidence_runs(words: DataFrame, by: list[str] = ["media_id"], below: float = 0.4, run: int = 3,
                        conf: str = "conf") -> DataFrame:
    """Runs of at least ``run`` consecutive words below ``below``: (by, start_ms, end_ms, n)."""
    low = F.coalesce(F.col(conf) < below, F.lit(False))
    x = scan(words.select(*by, "idx", "start_ms", "end_ms", low.alias("__low")), by, ["idx"], F.expr("idx div 4096"),
             __run=running_sum(F.when(F.col("__low"), 0).otherwise(1)))
    return (x.filter("__low").groupBy(*by, "__run")
            .agg(F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"),
                 F.count("*").alias("n")).filter(F.col("n") >= run).drop("__run"))


def repeated_phrases(words: DataFrame, by: list[str] = ["media_id"], max_n: int = 4, min_words: int = 6) -> DataFrame:
    """Phrases of up to ``max_n`` words said again straight after themselves, the repeats covering at least ``min_words``
    words: (by, first_idx, n, start_ms, end_ms). ``idx`` numbers the words of each ``by`` without gaps. At each place the
    longest cover counts, and the search goes on behind it: a walk over the places inside loops, each leading to the first one behind
    its cover, ranked by pointer doubling (``leap``), so a loop may be of any length."""
    x = words.select(*by, "idx", "start_ms", "end_ms", core("word").alias("__w"))
    x = with_neighbours(x, by, "idx", **{f"__w{n}": ("__w", n) for n in range(1, max_n + 1)})
    stops = {f"__x{n}": F.when(~F.coalesce((F.col("__w") != "") & (F.col("__w") == F.col(f"__w{n}")), F.lit(False)),
                               F.col("idx")) for n in range(1, max_n + 1)}
    x = scan(x.withColumns(stops).drop("__w", *[f"__w{n}" for n in range(1, max_n + 1)]), by, ["idx"],
             F.expr("idx div 4096"), **{f"__s{n}": next_seen(f"__x{n}") for n in range(1, max_n + 1)})
    best = F.lit(0).cast("bigint")
    for n in range(1, max_n + 1):  # a match of length L at distance n repeats the phrase floor(L / n) more times
        cover = F.expr(f"((__s{n} - idx) div {n} + 1) * {n}")
        best = F.greatest(best, F.when((cover >= max(min_words, 2 * n)), cover).otherwise(F.lit(0)))
    # The text's last word never matches anything ahead, so every place has a stop.
    c = stage(x.withColumn("__best", best).select(*by, "idx", "__best").filter("__best > 0"))  # places inside loops: few
    c = stage(scan(c, by, ["idx"], F.expr("idx div 4096"), __r=row_number()).withColumn("__r", F.col("__r") - 1))
    # From each place to the first place at or behind the end of its cover, if there is one.
    asks = c.select(*by, (F.col("idx") + F.col("__best")).alias("__at"), F.lit(0).alias("__k"), "__r", F.lit(None).cast("bigint").alias("__to"))
    ahead = scan(asks.unionByName(c.select(*by, F.col("idx").alias("__at"), F.lit(1).alias("__k"), "__r", F.col("__r").alias("__to"))), by, ["__at", "__k", "__r"],
                 F.expr("__at div 4096"), __next=next_seen("__to")).filter("__k = 0")
    picks = leap(ahead.select(*by, "__r", F.coalesce(F.col("__next") - F.col("__r"), F.lit(1 << 40)).alias("__n")), by, "__r", "__n")
    hit = c.join(picks.select(*by, "__r"), [*by, "__r"]).select(*by, F.col("idx").alias("first_idx"), F.col("__best").alias("n"))
    edge = words.select(*by, "idx", "start_ms", "end_ms")
    a = edge.select(*by, F.col("idx").alias("first_idx"), "start_ms")
    z = edge.select(*by, F.col("idx").alias("__last"), "end_ms")
    return (hit.withColumn("__last", F.col("first_idx") + F.col("n") - 1).join(a, [*by, "first_idx"])
            .join(z, [*by, "__last"]).select(*by, "first_idx", "n", "start_ms", "end_ms"))


def music_flag(units: DataFrame, words: DataFrame, turns: DataFrame, key: list[str] = ["media_id", "id"],
               by: list[str] = ["media_id"], min_ms: int = 8_000, conf_below: float = 0.6, conf: str = "conf") -> DataFrame:
    """Units with ``music``: long, doubtful by the median word, a phrase repeated inside, and no other speaker heard.
    ``words`` carry the unit's key and ``idx`` numbered inside the unit."""
    long_units = units.filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
    doubt = (words.join(long_units.select(*key), key, "left_semi").groupBy(*key)
             .agg(F.percentile(conf, F.lit(0.5)).alias("__m")).filter(F.col("__m") < conf_below).select(*key))
    rep = repeated_phrases(words.join(doubt, key, "left_semi"), key).select(*key).distinct()
    others = (overlap_join(long_units.select(*key, "speaker", "start_ms", "end_ms"), turns.select(*by, "speaker", "start_ms", "end_ms"), by)
              .filter("speaker <> b_speaker").select(*key).distinct())
    hit = rep.join(others, key, "left_anti").withColumn("__hit", F.lit(True))
    return units.join(hit, key, "left").withColumn("music", F.coalesce("__hit", F.lit(False))).drop("__hit")


def vet_redecode(found: DataFrame, words: DataFrame, gaps: DataFrame, by: list[str] = ["media_id"], pad_ms: int = 500,
                 no_speech_max: float = 0.6, low: float = 0.4) -> DataFrame:
    """What a second decode of each gap found, with ``keep``. A gap is rejected whole when it may hold no speech, its
    median confidence is low or it loops; a kept gap still loses a first (last) word equal to the first pass's word just
    before (after) it. ``found(by, gap_id, idx, word, conf, no_speech)``, ``gaps(by, gap_id, start_ms, end_ms)``."""
    key = [*by, "gap_id"]
    verdict = (found.groupBy(*key).agg(F.max("no_speech").alias("ns"), F.percentile("conf", F.lit(0.5)).alias("m"),
                                       F.min("idx").alias("__lo"), F.max("idx").alias("__hi"))
               .withColumn("__bad", (F.col("ns") > no_speech_max) | (F.col("m") < low)).select(*key, "__bad", "__lo", "__hi"))
    loops = repeated_phrases(found, key).select(*key).distinct().withColumn("__loop", F.lit(True))
    near = gaps.withColumns({"__a": F.col("start_ms"), "__z": F.col("end_ms")}).withColumns(
        {"start_ms": F.col("__a") - pad_ms - 60_000, "end_ms": F.col("__z") + pad_ms + 1})
    j = overlap_join(near, words.select(*by, "idx", "word", "start_ms", "end_ms"), by)
    before = (F.col("b_end_ms") >= F.col("__a") - pad_ms) & (F.col("b_end_ms") <= F.col("__a"))
    after = (F.col("b_start_ms") >= F.col("__z")) & (F.col("b_start_ms") <= F.col("__z") + pad_ms)
    edge = j.groupBy(*key).agg(F.max_by(core("b_word"), F.when(before, F.col("b_idx"))).alias("__wb"),
                               F.min_by(core("b_word"), F.when(after, F.col("b_idx"))).alias("__wa"))
    x = found.join(verdict, key).join(loops, key, "left").join(edge, key, "left")
    first = (F.col("idx") == F.col("__lo")) & (core("word") == F.col("__wb"))
    x = x.withColumn("__f", F.coalesce(first, F.lit(False)))
    last = (F.col("idx") == F.col("__hi")) & (core("word") == F.col("__wa"))
    drop = F.col("__bad") | F.coalesce("__loop", F.lit(False)) | F.col("__f") | F.coalesce(last, F.lit(False))
    return x.withColumn("keep", ~drop).select(*found.columns, "keep")


def _cased(word: Column, like: Column) -> Column:
    """``word`` with its first letter in the case of ``like``'s; "I" and acronyms keep their capital."""
    pat = "^([^\\p{L}]*)(\\p{L})(.*)$"
    parts = F.struct(*[F.regexp_extract(word, pat, k).alias(n) for k, n in ((1, "head"), (2, "ch"), (3, "rest"))], F.regexp_extract(like, pat, 2).alias("like"))

    def put(p: Column) -> Column:
        ch, lk = p["ch"], p["like"]
        tail = F.concat(ch, p["rest"])
        acronym = (F.regexp_count(tail, F.lit("\\p{L}")) >= 2) & (F.upper(tail) == tail)
        pronoun = F.split(core(F.regexp_replace(word, "’", "'")), "'")[0] == "i"
        up = F.concat(p["head"], F.upper(ch), p["rest"])
        low = F.concat(p["head"], F.lower(ch), p["rest"])
        return (F.when((ch == "") | (lk == ""), word).when(F.rlike(lk, F.lit("\\p{Lu}")), up)
                .when(F.rlike(lk, F.lit("\\p{Ll}")) & ~acronym & ~pronoun, low).otherwise(word))
    return let(parts, put)


def transfer_marks(words: DataFrame, styled: DataFrame, by: list[str] = ["media_id"], max_shift_ms: int = 1_000) -> DataFrame:
    """``words`` whose text takes the first-letter case and trailing marks of the same word in ``styled`` (another pass
    over the audio). Words match on their letters with midpoints at most ``max_shift_ms`` apart, each with its nearest,
    and only where both choose each other. No word or time changes."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*by, F.col("idx").alias(p + "idx"), F.col("word").alias(p + "word"),
                         core(F.regexp_replace("word", "’", "'")).alias("__core"),
                         (F.col("start_ms") + F.col("end_ms")).alias(p + "m2")).filter("__core <> ''")

    a, b = side(words, "a_"), side(styled, "s_")
    w = 2 * max_shift_ms  # in half milliseconds
    bx = b.withColumn("__b", F.explode(F.sequence(bucket_of(F.col("s_m2") - w, 2 * w), bucket_of(F.col("s_m2") + w, 2 * w))))
    j = (a.withColumn("__b", bucket_of("a_m2", 2 * w)).join(bx, [*by, "__core", "__b"])
         .withColumn("d", F.abs(F.col("a_m2") - F.col("s_m2"))).filter(F.col("d") <= w))
    j = stage(j.select(*by, "a_idx", "a_word", "s_idx", "s_word", "d"))  # both choices read it
    mine = j.groupBy(*by, "a_idx", "a_word").agg(F.min_by(F.struct("s_idx", "s_word"), F.struct("d", "s_idx")).alias("s"))
    theirs = j.groupBy(*by, "s_idx").agg(F.min_by("a_idx", F.struct("d", "a_idx")).alias("a_idx"))
    pair = mine.select(*by, "a_idx", "a_word", F.col("s.s_idx").alias("s_idx"), F.col("s.s_word").alias("s_word")).join(
        theirs, [*by, "s_idx", "a_idx"])
    marks = F.regexp_extract("s_word", "([.,?!;:…]*)$", 1)
    styled_word = let(F.struct(_cased(F.col("a_word"), F.col("s_word")).alias("word"), marks.alias("marks")), lambda x: F.when(
        x["marks"] == "", x["word"]).otherwise(F.concat(F.regexp_replace(x["word"], "[.,?!;:…]+$", ""), x["marks"])))
    hit = pair.select(*by, F.col("a_idx").alias("idx"), styled_word.alias("__w"))
    return words.join(hit, [*by, "idx"], "left").withColumn("word", F.coalesce("__w", "word")).select(*words.columns)


def drop_edge_guesses(words: DataFrame, windows: DataFrame, key: list[str] = ["media_id", "win"],
                      edge_ms: int = 1_000) -> DataFrame:
    """``words`` (with their window's key) without what a recogniser guesses at a cut: the trailing marks of a window's last
    word within ``edge_ms`` of its end, and a capitalised first word (not the pronoun I) within it of its start.
    ``windows(key, start_ms, end_ms)``: NULL where that side is the audio's own edge."""
    ends = words.groupBy(*key).agg(F.min("idx").alias("__lo"), F.max("idx").alias("__hi"))
    w = windows.select(*key, F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    x = words.join(ends.join(w, key), key)
    last = (F.col("idx") == F.col("__hi")) & F.coalesce(F.col("__e") - F.col("end_ms") <= edge_ms, F.lit(False))
    x = x.withColumn("word", F.when(last, F.regexp_replace("word", "[.,?!;:…]+$", "")).otherwise(F.col("word")))
    guess = ((F.col("idx") == F.col("__lo")) & F.coalesce(F.col("start_ms") - F.col("__s") <= edge_ms, F.lit(False))
             & F.rlike("word", F.lit("^[^\\p{L}]*\\p{Lu}")) & (F.split(core(F.regexp_replace("word", "’", "'")), "'")[0] != "i"))
    return x.filter(~guess).select(*words.columns)


def asr_report(words: DataFrame, turns: DataFrame, chunks: DataFrame, by: list[str] = ["media_id"], **kw) -> DataFrame:
    """Per chunk: words, uncovered speech, low-confidence runs and repeats, as counts and milliseconds."""
    own = own_words(words, chunks, by).groupBy(*by, "chunk_no").agg(F.count("*").alias("words"))

    def per(df: DataFrame, name: str) -> DataFrame:
        c = chunks.select(*by, "chunk_no", F.col("a_ms").alias("start_ms"), F.col("b_ms").alias("end_ms"))
        hit = point_join(df, c, by, "start_ms").filter("start_ms < b_end_ms")
        return hit.groupBy(*by, F.col("b_chunk_no").alias("chunk_no")).agg(
            F.count("*").alias(name), F.sum(F.col("end_ms") - F.col("start_ms")).alias(name + "_ms"))

    out = chunks.select(*by, "chunk_no", "a_ms", "b_ms").join(own, [*by, "chunk_no"], "left")
    for df, name in ((uncovered_speech(words, turns, by), "uncovered"), (low_confidence_runs(words, by, **kw), "low_confidence"),
                     (repeated_phrases(words, by), "repeats")):
        out = out.join(per(df.select(*by, "start_ms", "end_ms"), name), [*by, "chunk_no"], "left")
    return out.na.fill(0)
