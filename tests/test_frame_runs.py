import random

from speechgrid.operators import frames as fr
from speechgrid.plans.timing_queries import take_frames
from speechgrid.sources.fixtures import Tables


def test_runs_give_the_pauses_of_their_frames(spark):
    r = random.Random(3)
    runs, frames = [], []
    for take in range(40):
        at = 0
        for _ in range(r.randint(1, 12)):
            n, v = r.randint(0, 40), r.choice([0.0, 0.0, 0.001, 0.5, 0.9])
            runs.append((1, take, at, n, v))
            frames += [(1, take, at + i, v) for i in range(n)]
            at += n
    a = fr.pauses(spark.createDataFrame(runs, "media_id bigint, take bigint, frame_no bigint, n bigint, value double"))
    b = fr.pauses(spark.createDataFrame(frames, "media_id bigint, take bigint, frame_no bigint, value double"))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() > 20


def test_frames_of_words_travel_as_runs(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    x = take_frames(t)
    lines = t.words.selectExpr("media_id", "turn * 10000 + pos div 8").distinct().count()
    assert x.count() <= 2 * t.words.count() + lines
    assert x.selectExpr("sum(n)").first()[0] > 5 * t.words.count()
