import random

import pytest
from pyspark.sql import functions as F

from speechgrid.functions import quantiles as qs

ASKED = {"a": {"a0": 0.0, "a10": 0.1, "a50": 0.5, "a90": 0.9, "a1": 1.0}, "b": {"b50": 0.5, "b95": 0.95}}


def percentiles(df, by):
    return df.groupBy(*by).agg(*[F.percentile(F.col(m).cast("double"), F.lit(p)).alias(r) for m, ps in ASKED.items() for r, p in ps.items()])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket_rows", [7, 60, 200_000])
@pytest.mark.parametrize("seed", range(3))
def test_as_the_aggregate(spark, seed, bucket_rows):
    rng = random.Random(seed)
    draw = [lambda: rng.choice([None, -3.0, 0.0, 5.0]), lambda: rng.gauss(0, 1), lambda: 2.0 ** rng.randrange(-60, 60), lambda: float(rng.randrange(4))]
    data = [(f"g{g}", rng.randrange(3), draw[(g + seed) % 4](), draw[g % 4]()) for g in range(6) for _ in range(rng.choice([1, 2, 5, 300]))]
    data += [("none", 1, None, None), ("one", 1, 4.0, None), ("flat", 1, 2.0, 7.0), ("flat", 1, 2.0, 7.0)]
    df = spark.createDataFrame(data, "g string, k int, a double, b double")
    for by in (["g"], ["g", "k"]):
        got = rows(qs.quantiles(df, by, {m: (F.col(m), ps) for m, ps in ASKED.items()}, bucket_rows))
        assert got == [r for r in rows(percentiles(df, by)) if any(x is not None for x in r[len(by):])]


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, a double, b double")
    assert rows(qs.quantiles(df, ["g"], {m: (F.col(m), ps) for m, ps in ASKED.items()})) == []


def test_one_group_of_ten_million_rows_is_spread(spark, monkeypatch):
    # one group holds nearly all rows, three quarters of them in a thousandth of the range
    n, cut = 10_000_000, {}
    v = F.expr("if(id % 4 = 0, id, 40000000 + id % 8000)")
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 0, F.concat(F.lit("g"), F.col("id") % 7)).otherwise("hot").alias("g"), v.alias("a"), (-v).alias("b"))
    real = qs._cut

    def kept(counts, bucket_rows):
        cut["rows"] = real(counts, bucket_rows)
        return cut["rows"]

    monkeypatch.setattr(qs, "_cut", kept)
    got = rows(qs.quantiles(df, ["g"], {m: (F.col(m), ps) for m, ps in ASKED.items()}, 50_000))
    assert got == rows(percentiles(df, ["g"]))
    sizes = [r.n for r in cut["rows"].groupBy("g", "__m", "__b").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 60_000 < sum(sizes) / 50
