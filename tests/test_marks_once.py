from speechgrid.operators.transcript import transfer_marks


def test_candidate_pairs_are_made_once(spark):
    """Both choices read one stored table of candidate pairs: the words are not exploded and joined again for the second."""
    w = spark.createDataFrame([(1, 0, "hello", 0, 100), (1, 1, "WORLD", 200, 300), (1, 2, "i", 400, 450), (1, 3, "--", 500, 600)], "media_id long, idx long, word string, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, 0, "Hello,", 10, 110), (1, 1, "world!", 220, 320), (1, 2, "I", 420, 470), (1, 3, "hello.", 900, 990)], w.schema)
    out = transfer_marks(w, s)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.word for r in out.orderBy("idx").collect()] == ["Hello,", "WORLD!", "I", "--"]
