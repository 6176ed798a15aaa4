"""Walks of any reach: pointer doubling against the sequential walk, and the operators that use it on long islands."""

import random

import pytest
from pyspark.sql import functions as F

from speechgrid.functions import scan as sc
from speechgrid.operators import segment as sg
from speechgrid.operators import transcript as tr


@pytest.mark.parametrize("far", [1, 4, 90, 5000])
def test_leap_is_the_sequential_walk(spark, far):
    r = random.Random(far)
    rows = [(m, i, r.choice([1, r.randint(1, far), 1 << 40 if r.random() < 0.001 else 1])) for m in range(4) for i in range([1, 15, 700, 3000][m])]
    df = spark.createDataFrame(rows, "m bigint, seq bigint, n bigint")
    want = set()
    for m in range(4):
        js, i = [n for mm, _, n in rows if mm == m], 0
        while i < len(js):
            want.add((m, i, js[i]))
            i += js[i]
    got = [tuple(x) for x in sc.leap(df, ["m"], "seq", "n", size=16).collect()]
    assert len(got) == len(want) and set(got) == want


def test_leap_of_nothing_and_of_no_length(spark):
    df = spark.createDataFrame([], "m bigint, seq bigint, n bigint")
    assert sc.leap(df, ["m"], "seq", "n").collect() == []
    with pytest.raises(Exception, match="a jump below 1"):
        sc.leap(spark.createDataFrame([(1, 0, 0)], df.schema), ["m"], "seq", "n").collect()


def greedy(words, max_n=4, least=6):
    out, i = [], 0
    core = ["".join(c for c in w.lower() if c.isalnum() or c in "_'") for w in words]
    while i < len(core):
        best = 0
        for n in range(1, max_n + 1):
            k = i
            while k + n < len(core) and core[k] != "" and core[k] == core[k + n]:
                k += 1
            cover = ((k - i) // n + 1) * n
            if cover >= max(least, 2 * n):
                best = max(best, cover)
        if best:
            out.append((i, best))
        i += best or 1
    return out


def test_an_hour_of_one_word_and_of_mixed_loops(spark):
    r = random.Random(2)
    hour = ["no"] * 12_000
    mixed = []
    while len(mixed) < 4000:
        phrase = [r.choice("abc") for _ in range(r.randint(1, 5))]
        mixed += phrase * r.choice([1, 1, 2, 3, 9]) + ["x"] * r.randint(0, 2)
    texts = {1: hour, 2: mixed, 3: ["a"], 4: ["b", "c"] * 3000 + ["no"] * 5}
    rows = [(m, i, w, 300 * i, 300 * i + 250) for m, ws in texts.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "media_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint")
    got = sorted((x.media_id, x.first_idx, x.n, x.start_ms, x.end_ms) for x in tr.repeated_phrases(df).collect())
    want = sorted((m, i, n, 300 * i, 300 * (i + n - 1) + 250) for m, ws in texts.items() for i, n in greedy(ws))
    assert got == want and (1, 0, 12_000, 0, 300 * 11_999 + 250) in got


def test_six_thousand_units_joined_into_one(spark):
    # units of 2 ms without a full stop, far below the length limit; then a speaker who is cut every 20 s
    rows = [(1, "A", 3 * i, 3 * i + 2, f"w{i}") for i in range(6000)] + [(1, "B", 20_000 + 1000 * i, 20_900 + 1000 * i, f"v{i}") for i in range(50)]
    flags = "array(named_struct('s', start_ms, 'e', end_ms, 'ends', false, 'clause', false))"
    u = (spark.createDataFrame(rows, "media_id bigint, speaker string, start_ms bigint, end_ms bigint, text string")
         .withColumns({"words": F.expr(flags), "breaks": F.expr("cast(array() as array<int>)"), "anchors": F.expr("cast(array() as array<int>)"), "cut_off": F.lit(False)}))
    got = sg.join_seams(u).orderBy("id").collect()
    assert (got[0].speaker, got[0].start_ms, got[0].end_ms, len(got[0].words)) == ("A", 0, 17_999, 6000)
    assert got[0].text == " ".join(f"w{i}" for i in range(6000))
    assert [(g.id, g.start_ms, g.end_ms) for g in got[1:]] == [(1, 20_000, 39_900), (2, 40_000, 59_900), (3, 60_000, 69_900)]
