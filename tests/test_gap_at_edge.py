from speechgrid.operators import intervals as iv


def test_a_gap_that_begins_at_a_bucket_edge_joins_no_earlier_gap(spark):
    # what covers ends where a bucket does: the gap after it does not go on from the one before, a gap over the next edge does
    win = spark.createDataFrame([(1, 0, 3_500), (2, 0, 4_000)], "media_id bigint, start_ms bigint, end_ms bigint")
    cover = spark.createDataFrame([(1, 100, 1_000), (1, 2_300, 2_400), (2, 0, 1_000), (2, 1_000, 2_000)], "media_id bigint, start_ms bigint, end_ms bigint")
    want = {(1, 0, 100), (1, 1_000, 2_300), (1, 2_400, 3_500), (2, 2_000, 4_000)}
    for width in (100, 500, 1_000, 600_000):
        assert {tuple(r) for r in iv.interval_subtract(win, cover, ["media_id"], bucket_ms=width).collect()} == want, width


def test_long_gaps_over_ten_minutes(spark):
    win = spark.createDataFrame([(1, 0, 600_500)], "media_id bigint, start_ms bigint, end_ms bigint")
    cover = spark.createDataFrame([(1, 900, 600_000)], "media_id bigint, start_ms bigint, end_ms bigint")
    assert {tuple(r) for r in iv.interval_gaps(win, cover, ["media_id"], 400).collect()} == {(1, 0, 900), (1, 600_000, 600_500)}
