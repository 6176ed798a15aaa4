from speechgrid.operators import intervals as iv


def test_points_of_one_turn_are_one_row_of_a_chunk(spark, monkeypatch):
    """A chunk's array holds a row a run of equally tied points, so it does not grow with the points."""
    kept = []
    monkeypatch.setattr(iv, "stage", lambda df, real=iv.stage: kept.append(real(df)) or kept[-1])
    p = spark.createDataFrame([(1, i, 100 * i) for i in range(60)], "media_id long, idx long, mid long")
    t = spark.createDataFrame([(1, "A", 0, 1950), (1, "B", 1950, 3950), (1, "C", 2950, 4950), (1, "B", 700_000, 700_001)], "media_id long, speaker string, start_ms long, end_ms long")
    got = [r.speaker for r in iv.nearest_turn(p, t, "mid", ["idx"], mode="segmenter").orderBy("idx").collect()]
    # both of B and C are 2 s long: where they overlap the point before decides; after C and half a second the last one stays
    assert got == ["A"] * 20 + ["B"] * 20 + ["C"] * 20
    sizes = [len(r.ps) for k in kept if "ps" in k.columns for r in k.collect()]
    assert sizes and max(sizes) <= 6
