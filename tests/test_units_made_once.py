from pyspark.sql import functions as F

from speechgrid.operators import segment as sg


def test_units_are_made_once(spark):
    """The scan over the units reads them twice; they are stored before, not segmented twice."""
    seen = spark.sparkContext.accumulator(0)

    def made(parts):
        for p in parts:
            seen.add(len(p))
            yield p
    flags = "array(named_struct('s', start_ms, 'e', end_ms, 'ends', false, 'clause', false))"
    none = F.expr("cast(array() as array<int>)")
    u = (spark.createDataFrame([(1, "A", 0, 900, "a b"), (1, "A", 1000, 1900, "c."), (1, "A", 2000, 2900, "d")], "media_id bigint, speaker string, start_ms bigint, end_ms bigint, text string")
         .mapInPandas(made, "media_id bigint, speaker string, start_ms bigint, end_ms bigint, text string")
         .withColumns({"words": F.expr(flags), "breaks": none, "anchors": none, "cut_off": F.lit(False)}))
    got = [(r.id, r.text) for r in sg.join_seams(u).orderBy("id").collect()]
    assert got == [(0, "a b c."), (1, "d")]
    assert seen.value == 3
