import numpy as np

from speechgrid.llm import neighbours as N


def test_lists_read_follow_the_vectors(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 24))
    t = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = list(range(0, 6000, 30))
    got = {}
    for r in N.nearest_neighbours(t, t.filter("vec_id % 30 = 0"), k=10, list_rows=16, probes=8, least_probes=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-score, axis=1)[:, :10]
    assert np.mean([len(got[q] & set(w)) / 10 for q, w in zip(asked, want.tolist(), strict=True)]) >= 0.9


def test_all_centroids_in_order():
    rng = np.random.default_rng(3)
    index = N.build(rng.normal(size=(4000, 8)).astype(np.float32), 10.0, 256)
    q = index.lift(rng.normal(size=(50, 8)).astype(np.float32), True)
    far = np.sqrt(((q[:, None] - index.centroids[None]) ** 2).sum(-1))
    ids, dist = index.nearest(q, 200)
    assert np.allclose(dist, np.sort(far, axis=1)[:, :200], atol=1e-4) and all(len(set(r)) == 200 for r in ids.tolist())
