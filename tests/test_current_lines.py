import json

from speechgrid.streaming import trace_streams as st


def test_current_lines_whatever_the_order_of_events(spark, tmp_path):
    """An override that comes after a later one of the other column still counts; the state is kept without Python."""
    e = [dict(event="rephrase", outcome="replaced", t_ms=3_000, event_id=3, freeze_ms=0), dict(event="unit", t_ms=1_000, event_id=1, said="whole", freeze_ms=40),
         dict(event="rephrase", outcome="replaced", t_ms=2_000, event_id=2, said="pieces", freeze_ms=9), dict(event="rephrase", outcome="kept", t_ms=9_000, event_id=9, said="joined")]
    out, seen = None, tmp_path / "in"
    seen.mkdir()
    for x in e:
        (seen / f"{x['event_id']}.json").write_text(json.dumps(dict(x, media_id=1, id=7)))
        s = st.current_lines(st.trace_stream(spark, str(seen)))
        out = st.run_available(s, str(tmp_path / "out"), "update", ["media_id", "id"])
    assert [(r.media_id, r.id, r.said, r.freeze_ms, r.t_ms) for r in out.collect()] == [(1, 7, "pieces", 0, 1_000)]
