"""Speaker folds, the squeeze and reply rules on small cases worked out by hand or by brute force."""

import itertools
import random

from pyspark.sql import functions as F

from speechgrid.operators import frames as fr
from speechgrid.operators import replies as rp
from speechgrid.operators import speakers as sp
from speechgrid.operators import timing as tm


def vec(*x):
    return [float(v) for v in x]


def test_link_keeps_ids_over_blocks(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 30_000), (1, 1, 25_000, 60_000)], "media_id bigint, block_no bigint, start_ms bigint, end_ms bigint")
    turns = spark.createDataFrame([(1, 0, "a", 0, 8_000), (1, 0, "b", 9_000, 20_000), (1, 1, "x", 30_000, 40_000), (1, 1, "y", 41_000, 50_000), (1, 1, "z", 52_000, 53_000),
                                   (1, 1, "w", 54_000, 57_000)], "media_id bigint, block_no bigint, label string, start_ms bigint, end_ms bigint")
    cents = spark.createDataFrame([(1, 0, "a", vec(1, 0, 0)), (1, 0, "b", vec(0, 1, 0)), (1, 1, "x", vec(0.1, 0.9, 0)), (1, 1, "y", vec(0.9, 0.2, 0)), (1, 1, "z", vec(1, 0.1, 0)),
                                   (1, 1, "w", vec(0, 0, 1))], "media_id bigint, block_no bigint, label string, centroid array<double>")
    got = {(r.block_no, r.label): r.speaker for r in sp.link_speakers(blocks, turns, cents).collect()}
    assert got == {(0, "a"): "S1", (0, "b"): "S2", (1, "x"): "S2", (1, "y"): "S1", (1, "z"): "S1", (1, "w"): "S3"}


def test_settle_merges_small_and_alike(spark):
    s = spark.createDataFrame([(1, "S1", vec(1, 0), 100_000, 5_000), (1, "S2", vec(0, 1), 90_000, 0), (1, "S3", vec(0.1, 1), 4_000, 9_000), (1, "S4", vec(1, 0.05), 50_000, 20_000)],
                              "media_id bigint, speaker string, centroid array<double>, talk_ms bigint, first_ms bigint")
    t = spark.createDataFrame([(1, "S1", 5_000, 6_000)], "media_id bigint, speaker string, start_ms bigint, end_ms bigint")
    got = {r.speaker: (r.final_speaker, r.into, r.why) for r in sp.settle_speakers(s, t).collect()}
    assert got == {"S1": ("S2", None, None), "S2": ("S1", None, None), "S3": ("S1", "S2", "talk"), "S4": ("S2", "S1", "same")}


def test_match_ids_is_the_best_assignment(spark):
    r = random.Random(4)
    cur, old = [], []
    for m in range(12):
        for t in range(25):
            cur.append((m, f"S{r.randint(1, 4)}", t * 1000, t * 1000 + 900))
            old.append((m, f"S{r.randint(1, 5)}", t * 1000 + r.randint(0, 500), t * 1000 + 800))
    shape = "media_id bigint, speaker string, start_ms bigint, end_ms bigint"
    got = {}
    for x in sp.match_ids(spark.createDataFrame(old, shape), spark.createDataFrame(cur, shape)).collect():
        got.setdefault(x.media_id, {})[x.speaker] = x.new_speaker
    for m in range(12):
        c, o = [x for x in cur if x[0] == m], [x for x in old if x[0] == m]
        share = {}
        for a, b in itertools.product(c, o):
            v = min(a[3], b[3]) - max(a[2], b[2])
            if v > 0:
                share[a[1], b[1]] = share.get((a[1], b[1]), 0) + v
        new, olds = sorted(got[m]), sorted({x[1] for x in o})
        best = max(sum(share.get((n, p), 0) for n, p in zip(new, pick) if p) for pick in itertools.permutations([*olds, *[None] * len(new)], len(new)))
        assert sum(share.get((n, p), 0) for n, p in got[m].items()) == best
        assert len(set(got[m].values())) == len(new)


def test_squeeze_lands_on_the_length(spark):
    r = random.Random(2)
    rows = []
    for i in range(200):
        ps = [r.randint(150, 1500) for _ in range(r.randint(0, 5))]
        rows.append((i, sum(ps) + r.randint(500, 6000), 1 + r.random() * 0.9, ps))
    df = spark.createDataFrame(rows, "id bigint, total_ms bigint, rate double, pauses array<bigint>")
    for x in fr.squeeze(df).collect():
        length = x.total_ms / x.speech_rate - sum(x.cuts)
        assert abs(length - x.total_ms / x.rate) < 1e-6
        assert x.speech_rate <= x.rate + 1e-9
        assert all(d / x.speech_rate - c >= min(120, d / x.speech_rate) - 1e-6 for d, c in zip(x.pauses, x.cuts))


def test_breaks_match_the_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(60):
        b = sorted(r.random() for _ in range(r.randint(2, 6)))
        rows.append((i, [r.randint(1, 9) * 1.0 for _ in range(r.randint(2, len(b) + 1))], b))
    for x in tm.match_breaks(spark.createDataFrame(rows, "id bigint, durations array<double>, break_share array<double>")).collect():
        n, total = len(x.durations) - 1, sum(x.durations)
        said = [sum(x.durations[:k + 1]) / total for k in range(n)]
        cost = lambda ix: sum(abs(s - x.break_share[i]) for s, i in zip(said, ix))
        best = min(itertools.combinations(range(len(x.break_share)), n), key=cost)
        assert len(x.picked) == n and abs(cost(x.picked) - cost(best)) < 1e-9


def test_ids_as_json(spark):
    raw = ["3", "3.0", "true", '"3"', "3.5", "null", "-2"]
    df = spark.createDataFrame([(x,) for x in raw], "r string").select(rp.whole_id("r").alias("v"))
    assert [x.v for x in df.collect()] == [3, 3, None, None, None, None, -2]


def test_best_span_score_rejects_a_batch(spark):
    rows = [(1, "A", 0, i * 1000, i * 1000 + 900, 1.0 - i * 0.1, None if i < 8 else 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "media_id bigint, speaker string, late int, start_ms bigint, end_ms bigint, score double, extra double")
    got = sp.best_span(df, score_col="extra").collect()
    assert [(x.start_ms, x.score) for x in got] == [(8000, 0.2)] or [x.start_ms for x in got] == [8000]
    assert sp.best_span(df.withColumn("extra", F.lit(float("nan"))), score_col="extra").count() == 0
