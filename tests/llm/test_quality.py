import numpy as np
import pytest

from speechgrid.llm import quality as Q


def test_features():
    assert not Q.features(b"").any() and len(Q.features(b"a b\nA b\n")) == Q.N_FEATURES
    x = Q.features(b"AB ab\nAB ab\n!")
    assert x[-5] == pytest.approx(1 / 3) and x[-2] == pytest.approx(0.5) and x[-3] == pytest.approx(1 / 13) and x[ord("A")] == pytest.approx((2 / 13) ** 0.5)


def test_weights_minimise_the_pair_loss():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.8).astype(int)
    x = rng.normal(size=(400, 5)) + y[:, None] * np.array([1.0, 0, -0.5, 0, 0])
    m = Q.fit_pairs(x, y, 2000, 0.01)
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    z = (x - m.mean) / m.spread
    d = z[good[rng.permutation(np.arange(2000) % len(good))]] - z[bad[rng.permutation(np.arange(2000) % len(bad))]]
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 0.005 * w @ w
    for _ in range(50):
        assert loss(m.weights) <= loss(m.weights + rng.normal(size=5) * 0.05)
    s = m.score(x)
    assert (s < 0.5).sum() == (y == 0).sum()
    assert ((s[y == 1][:, None] > s[y == 0][None, :]).mean()) > 0.7


def test_cut_at_the_share_of_all_labelled():
    """Half of the rows are bad, but each good one stands for nine: a tenth of what they stand for falls below the cut."""
    rng = np.random.default_rng(5)
    y = np.arange(600) % 2
    x = rng.normal(size=(600, 4)) + y[:, None] * np.array([0.8, 0, 0.4, 0])
    many = np.where(y == 1, 9.0, 1.0)
    low = Q.fit_pairs(x, y, 2000, 0.01, many=many).score(x) < 0.5
    assert abs(many[low].sum() / many.sum() - 0.1) < 0.004
    assert (Q.fit_pairs(x, y, 2000, 0.01).score(x) < 0.5).mean() == pytest.approx(0.5, abs=0.002)


@pytest.mark.parametrize("only", [0, 1])
def test_one_label_only(only):
    m = Q.fit_pairs(np.ones((4, 3)), np.full(4, only), 10, 0.01)
    assert ((m.score(np.ones((2, 3))) >= 0.5) == bool(only)).all()


def test_scores(spark, docs_of):
    good, bad = "a calm line of words that says something new each time {}", "$$$ {} ### %%% &&& $$$ ###"
    rows = [(i, (good if i % 4 else bad).format(i * 7919)) for i in range(200)] + [(900, None), (901, ""), (None, good), (902, "word " * 200_000), (3, good)]
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(0, 150)] + [(1, 1, 0), (2, 7, 0), (3, None, 0), (None, 1, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    model = Q.learn(docs_of(rows), labels)
    got = Q.quality_scores(docs_of(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == int(bool(r.doc_id % 4)) for r in got if r.doc_id is not None and 150 <= r.doc_id < 200)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    assert Q.quality_scores(docs_of([]), model).count() == 0
    assert Q.learn(docs_of(rows), labels.filter("false")) is None
    assert {r.score for r in Q.quality_scores(docs_of(rows), None).collect()} == {0.5}


def test_held_out_accuracy(spark):
    from speechgrid.llm import queries

    folder = "/root/testdata/sf0.01"
    got = queries.op9_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 80 and sum(r.quality == r.predicted for r in got) / len(got) > 0.95


def test_every_labelled_row_takes_part(spark, docs_of):
    """More rows than the sample held: mean, cut and weights are those of all of them."""
    rows = [(i, ("calm words say {} something new" if i % 90 else "$ {} ## % words").format(i * 7919 % 10007)) for i in range(9000)]
    labels = spark.createDataFrame([(i, int(bool(i % 90) ^ (i % 450 == 7))) for i in range(9000)], "doc_id long, quality int")
    m = Q.learn(docs_of(rows), labels)
    x, y = np.array([Q.features(t.encode()) for _, t in rows]), np.array([int(bool(i % 90) ^ (i % 450 == 7)) for i in range(9000)])
    np.testing.assert_allclose(m.mean, x.mean(axis=0), atol=1e-12)
    np.testing.assert_allclose(m.spread, np.maximum(x.std(axis=0), 0.02), atol=1e-9)
    s = m.strength(x)
    assert (s < m.cut).sum() <= (y == 0).sum() <= (s <= m.cut).sum()
    # fewer than two buckets' worth of bad rows: the loss is over all pairs, and its gradient is nought
    z = (x - m.mean) / m.spread
    good, bad = z[y == 1], z[y == 0]
    assert len(bad) < 2 * Q.RARER
    p = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None, :]))
    gradient = (good.T @ p.sum(axis=1) - bad.T @ p.sum(axis=0)) / p.size - 0.003 * m.weights
    assert np.abs(gradient).max() < 1e-5


def test_buckets_cover_every_row(spark):
    """Many bad rows: several buckets, and blocks that part a bucket's common rows; each row counts once."""
    x = np.random.default_rng(1).random((700, Q.N_FEATURES))
    rows = sorted((i % 3, i % 10 != 0, x[i].tobytes()) for i in range(700))
    import zlib

    import pyarrow as pa
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k:k + 90]]), pa.array([r[1] for r in rows[k:k + 90]]), pa.array([zlib.compress(r[2]) for r in rows[k:k + 90]])], names=["b", "c", "x"])
               for k in range(0, 700, 90)]
    old, Q.BLOCK = Q.BLOCK, 50
    try:
        blocks = [b.to_pylist()[0] for b in Q._blocks(iter(batches))]
    finally:
        Q.BLOCK = old
    total = sum(Q._moments(Q._rows(b["rare"]), Q._rows(b["common"]), b["fresh"]) for b in blocks)
    np.testing.assert_allclose(total[0, :-1], x.sum(axis=0))
    of = lambda k, c: sum(i % 3 == k and (i % 10 != 0) == c for i in range(700))
    assert total[0, -1] == sum(of(k, True) * of(k, False) for k in range(3))
