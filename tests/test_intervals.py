"""Interval algebra on random timelines: plain Python answers, bucket width does not matter, lengths add up."""

import random

from pyspark.sql import functions as F

from speechgrid.functions import scan as sc
from speechgrid.operators import intervals as iv

SPAN = "m bigint, k bigint, start_ms bigint, end_ms bigint"


def timeline(seed, n, top=60_000):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a = r.randrange(0, top)
        out.append((seed % 3, k, a, a + r.choice([0, 1, 5, 200, 1500, 9000, 30_000])))
    return out


def union(spans, joins):
    got = []
    for a, b in sorted((a, b) for a, b in spans if b > a):
        if got and joins(a, got[-1][1]):
            got[-1][1] = max(got[-1][1], b)
        else:
            got.append([a, b])
    return [tuple(x) for x in got]


def by_media(rows):
    got = {}
    for r in rows:
        got.setdefault(r.m, []).append((r.start_ms, r.end_ms))
    return {m: sorted(v) for m, v in got.items()}


def frames(spark, seed, n):
    rows = [x for s in (seed, seed + 1, seed + 2) for x in timeline(s, n)]
    return rows, spark.createDataFrame(rows, SPAN)


def test_union_variants(spark):
    rows, df = frames(spark, 3, 30)
    media = {m: [(a, b) for mm, _, a, b in rows if mm == m] for m in {r[0] for r in rows}}
    rules = [(dict(), lambda a, e: a <= e), (dict(touch=False), lambda a, e: a < e), (dict(touch=False, bridge_ms=700), lambda a, e: a < e + 700),
             (dict(slack_ms=1), lambda a, e: a <= e + 1)]
    for kw, joins in rules:
        want = {m: union(v, joins) for m, v in media.items()}
        for width in (None, 1_000, 7_001, 600_000):
            assert by_media(iv.interval_union(df, ["m"], bucket_ms=width, **kw).collect()) == want, (kw, width)


def test_touching_spans_stay_apart_across_bucket_edges(spark):
    df = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 1000, 2500), (1, 2, 3000, 3100)], SPAN)
    got = by_media(iv.interval_union(df, ["m"], touch=False, bucket_ms=1000).collect())
    assert got == {1: [(0, 1000), (1000, 2500), (3000, 3100)]}


def test_subtract_and_lengths(spark):
    rows, a = frames(spark, 10, 12)
    _, b = frames(spark, 40, 12)
    cut = [(r[0], r[2], r[3]) for r in [x for s in (40, 41, 42) for x in timeline(s, 12)]]
    want = set()
    for m, k, s, e in rows:
        points = sorted({s, e, *[p for mm, x, y in cut if mm == m and y > x for p in (x, y) if s < p < e]})
        parts = [(p, q) for p, q in zip(points, points[1:]) if not any(mm == m and x <= p and q <= y for mm, x, y in cut)]
        want |= {(m, k, *u) for u in union(parts, lambda p, q: p <= q)}
    for width in (900, 600_000):
        got = {(r.m, r.k, r.start_ms, r.end_ms) for r in iv.interval_subtract(a, b, ["m"], bucket_ms=width).collect()}
        assert got == want
    ab = a.select("m", "start_ms", "end_ms").union(b.select("m", "start_ms", "end_ms"))
    n = lambda df: {r.m: r.length_ms for r in iv.interval_length(df, ["m"]).collect()}
    both = {r.m: r.shared_ms for r in iv.shared_length(a, b, ["m"]).collect()}
    la, lb, lab = n(a), n(b), n(ab)
    assert all(lab[m] + both.get(m, 0) == la.get(m, 0) + lb.get(m, 0) for m in lab)


def test_scan_is_the_plain_window(spark):
    r = random.Random(5)
    rows = [(k % 2, k, r.randrange(0, 50_000), r.choice([None, k])) for k in range(300)]
    df = spark.createDataFrame(rows, "m bigint, k bigint, t bigint, v bigint")
    steps = dict(p=sc.prev("v"), n=sc.following("v"), s=sc.running_sum("k"), x=sc.running_sum("k", False), top=sc.running_max("v"), l=sc.last_seen("v"),
                 le=sc.last_seen("v", False), a=sc.next_seen("v"), rn=sc.row_number())
    cols = ["m", "k", *steps]
    one = sc.scan(df, ["m"], ["t", "k"], None, **steps).select(cols).orderBy("m", "k").collect()
    two = sc.scan(df, ["m"], ["t", "k"], F.expr("t div 1777"), **steps).select(cols).orderBy("m", "k").collect()
    assert one == two


def test_walk_is_the_sequential_walk(spark):
    r = random.Random(8)
    rows = [(m, i, r.randint(1, 6)) for m in range(3) for i in range([1, 700, 3000][m])]
    df = spark.createDataFrame(rows, "m bigint, seq bigint, n int")
    want = set()
    for m in range(3):
        js, i = [n for mm, _, n in rows if mm == m], 0
        while i < len(js):
            want.add((m, i, js[i]))
            i += js[i]
    got = {tuple(x) for x in sc.walk(df, ["m"], "seq", "n", longest=6, size=16, fan=8).collect()}
    assert got == want


def test_neighbours(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)], "m bigint, seq bigint")
    got = sc.with_neighbours(df, ["m"], "seq", size=8, b=("seq", -2), a=("seq", 3)).collect()
    assert {(r.seq, r.b, r.a) for r in got} == {(i, i - 2 if i >= 2 else None, i + 3 if i < 97 else None) for i in range(100)}


def test_wide_joins_are_equi_joins(spark):
    _, a = frames(spark, 1, 5)
    plan = iv.interval_overlap(a, a, ["m"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_ties_go_to_the_speaker_of_the_point_before(spark):
    # A and B are equally far from the first point, B and C from the second, C and B from the third
    turns = spark.createDataFrame([(1, "A", 0, 800), (1, "B", 1_000, 1_600), (1, "C", 1_800, 2_100), (1, "B", 2_300, 2_600)], "media_id bigint, speaker string, start_ms bigint, end_ms bigint")
    points = spark.createDataFrame([(1, k, t) for k, t in enumerate((900, 1_700, 2_200))], "media_id bigint, idx bigint, mid bigint")
    for chunk in (500, 600_000):
        got = {r.idx: r.speaker for r in iv.nearest_turn(points, turns, "mid", ["idx"], near_ms=100, chunk_ms=chunk).collect()}
        assert got == {0: "B", 1: "B", 2: "B"}
    r = random.Random(3)
    for mode in ("registry", "segmenter"):
        turns = [(f"S{r.randint(1, 4)}", a := 200 * k, a + 100) for k in range(0, 60)]
        pts = sorted(150 + 200 * r.randint(0, 62) for _ in range(80))
        prev, want = None, []
        for t in pts:
            near = {}
            for s, a, e in turns:
                d = max(a - t, t - e, 0)
                if d <= 60:
                    near.setdefault(d, []).append((-a if mode == "registry" else a, s))
            if near:
                best = sorted(near[min(near)])
                prev = prev if prev in [s for _, s in best] else best[0][1]
            elif prev is None:
                prev = None
            want.append(prev)
        tf = spark.createDataFrame([(1, *x) for x in turns], "media_id bigint, speaker string, start_ms bigint, end_ms bigint")
        pf = spark.createDataFrame([(1, k, t) for k, t in enumerate(pts)], "media_id bigint, idx bigint, mid bigint")
        got = {x.idx: x.speaker for x in iv.nearest_turn(pf, tf, "mid", ["idx"], near_ms=60, mode=mode, chunk_ms=700).collect()}
        assert [got[k] for k, w in enumerate(want) if w] == [w for w in want if w]
