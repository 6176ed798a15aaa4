from speechgrid.plans.catalog import QUERIES
from speechgrid.sources.fixtures import Tables


def test_envelope_returns_every_frame(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    g = QUERIES["gain_envelope"](spark, "/root/testdata/sf0.001")
    assert g.columns == ["media_id", "frame_no", "gain"]
    assert g.count() == t.durations.selectExpr("sum((duration_ms - 1) div 100 + 1)").first()[0]


def test_envelope_by_brute_force_and_without_shuffled_frames(spark):
    import math
    import random

    from speechgrid.operators import frames as fr

    r = random.Random(5)
    spans = [(1, s, s + r.randint(1, 30_000), r.choice(["duck", "bare"])) for s in (r.randint(0, 60_000) for _ in range(12))]
    x = fr.gain_envelope(spark.createDataFrame(spans, "media_id bigint, start_ms bigint, end_ms bigint, kind string"), spark.createDataFrame([(1, 70_001)], "media_id bigint, duration_ms bigint"))

    def ramp(t, s, e):
        if t < s - 150 or t >= e + 400:
            return 0.0
        return 0.5 - 0.5 * math.cos(math.pi * (t - s + 150) / 150) if t < s else 1.0 if t < e else 0.5 + 0.5 * math.cos(math.pi * (t - e) / 400)

    got = {w.frame_no: w.gain for w in x.collect()}
    assert sorted(got) == list(range(701))
    for f, gain in got.items():
        d, b = (max(ramp(f * 100, s, e) if k == kind else 0.0 for _, s, e, k in spans) for kind in ("duck", "bare"))
        assert abs(gain - 10 ** ((d * -6 + b * -6) / 20)) < 1e-12
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "frame_no" in line]
