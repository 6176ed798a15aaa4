import random

import duckdb
import __spark_entry__ as entry
from pyspark.sql import functions as F

from speechgrid.functions.quantiles import quantiles

PATH = "/root/testdata/sf0.01"


def test_scale_sweep_is_its_sql_to_the_last_bit(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{PATH}/conversations.parquet')")
    got = entry.queries()["scale_sweep"](spark, PATH)
    want = con.execute(entry.oracle_sql()["scale_sweep"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 0


def test_fused_quantiles_are_quantile_cont(spark):
    r = random.Random(6)
    draw = [lambda: r.uniform(0.5, 1.5), lambda: r.choice([1.0, 1.25, 1.1]), lambda: r.gauss(0, 1e6), lambda: float(r.randrange(9))]
    data = [(g, draw[g % 4]()) for g in range(400) for _ in range(r.choice([1, 2, 3, 10, 77]))] + [(400, None)]
    df = spark.createDataFrame(data, "g int, v double")
    ps = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", data)
    want = con.execute(f"SELECT g, {', '.join(f'quantile_cont(v, {p})' for p in ps.values())} FROM t WHERE v IS NOT NULL GROUP BY g ORDER BY g").fetchall()
    for rows in (50, 200_000):
        assert [tuple(x) for x in quantiles(df, ["g"], {"v": (F.col("v"), ps)}, rows, fused=True).orderBy("g").collect()] == want
