from speechgrid.operators import timing as tm


def test_a_voice_is_asked_for_whole_behind_a_join(spark):
    """Behind a join by voice a repartition is dropped, and adaptive execution may read the join's shuffle in pieces: the plan itself
    must ask for whole voices, in order."""
    x = spark.range(2_000, numPartitions=8).selectExpr("id % 5 AS voice", "id div 5 AS at", "8L AS units", "double(id % 7 + 1) AS seconds")
    one = x.join(x.select("voice").distinct(), "voice", "left_semi")
    paces = tm.online_pace(one)
    plan = paces._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.index("MapInPandas") < plan.index("Window") < plan.index("Join")
    assert sorted((r.voice, r.n) for r in paces.collect()) == [(v, 400) for v in range(5)]
