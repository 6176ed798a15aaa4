import numpy as np
import pytest

from speechgrid.llm import neighbours as N


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, x in out.items():
        x.sort()
        assert [r for r, _, _ in x] == list(range(1, len(x) + 1))
    return {q: [(i, s) for _, i, s in x] for q, x in out.items()}


@pytest.fixture(scope="module")
def table_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, list int, score double")
    return make


def test_few_rows_are_searched_exactly(table_of):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(40)]
    rows = [(i, v) for i, v in rows if any(v)]
    bad = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0]), (None, [9.0, 9.0, 9.0, 9.0])]
    t = table_of([*rows, *bad, rows[3]])
    got = results(N.nearest_neighbours(t, t.filter("vec_id % 5 = 0"), k=7))
    want = brute(rows, [(i, v) for i, v in rows if i % 5 == 0], 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_fewer_candidates_than_asked_and_none(table_of):
    t = table_of([(1, [1.0, 0.0]), (2, [1.0, 1.0])])
    assert results(N.nearest_neighbours(t, k=5)) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    assert N.nearest_neighbours(table_of([]), k=5).count() == 0
    assert N.nearest_neighbours(table_of([(1, None)]), k=5).count() == 0
    assert N.nearest_neighbours(table_of([(1, [1.0])]), k=5).count() == 0


def test_recall_and_split_lists(table_of):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(size=16) * 0.5).tolist()) for i in range(3000)]
    t = table_of(rows)
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    got = results(N.nearest_neighbours(t, t.filter("vec_id % 20 = 0"), k=10, list_rows=64, probes=24, least_probes=8, longest=50))
    want = brute(rows, queries, 10)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    by = dict(rows)
    assert all(s == pytest.approx(float(np.dot(by[q], by[i]))) for q, x in got.items() for i, s in x)


def test_walk_finds_nearest_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    index = N.build(x, 10.0, 256)
    assert {len(p) for p in N.halve(x, np.arange(4000), 16, rng)} <= {15, 16}
    q = index.lift(x[:200], True)
    ids, dist = index.nearest(q, 16)
    assert all(len(set(row)) == 16 for row in ids.tolist())
    far = np.sqrt(((q[:, None] - index.centroids[None]) ** 2).sum(-1))
    assert np.mean([len(set(a) & set(np.argsort(b)[:16])) / 16 for a, b in zip(ids.tolist(), far, strict=True)]) > 0.95
    assert np.allclose(np.take_along_axis(far, ids, 1), dist, atol=1e-3) and (np.diff(dist) >= 0).all()


def test_recall_on_the_table(spark):
    from speechgrid.llm import queries

    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = results(queries.op2_nearest(spark, folder))
    want = brute(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
