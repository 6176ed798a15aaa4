from decimal import Decimal

import numpy as np
import pytest

from speechgrid.llm import queries, whitening


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 9, 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, n long, whitened double")


def against(rows, got, components=8):
    """All values of ``got`` against a dense decomposition of the same integers."""
    fit = [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in fit], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = ((n * x - s) / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    many = int((e > 1e-13 * e[0]).sum()) if e[0] > 0 else 0
    assert len(got) == n * many
    dev = sorted((i, int(d)) for (i, _), d in zip(fit, ((n * x - s) ** 2).sum(axis=1)) for _ in range(many))
    assert sorted((r.vec_id, int(r.deviation)) for r in got) == dev
    assert {r.n for r in got} <= {n} and all(r.identity_error <= 1e-4 for r in got)
    for k in range(many):
        mine = sorted((r.vec_id, r.whitened) for r in got if r.component == k + 1)
        want = y @ u[:, k] / np.sqrt(e[k])
        assert any(np.allclose(mine, sorted((i, float(sign * w)) for (i, _), w in zip(fit, want)), atol=1e-7) for sign in (1, -1))
        assert abs(next(r.explained for r in got if r.component == k + 1) / (e[k] / (y ** 2).sum() * n) - 1) < 1e-9


def test_as_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.standard_normal((300, 24)) * np.linspace(2, 0.1, 24)).astype(np.float32))]
    bad = [(900, None), (901, []), (902, [1.0] * 23), (903, [None] + [1.0] * 23), (904, [float("nan")] * 24), (905, [float("inf")] + [0.0] * 23)]
    rows += [(7, rows[0][1]), (7, rows[1][1])]
    against(rows, whitening.whiten(table(spark, rows + bad)).collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.5, 1.5])] * 5])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(table(spark, rows)).collect() == []


def test_fewer_directions_than_components(spark):
    rng = np.random.default_rng(5)
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(40)]
    against(line, whitening.whiten(table(spark, line)).collect())
    few = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((5, 12)).astype(np.float32))]
    against(few, whitening.whiten(table(spark, few)).collect())


def test_null_ids_and_numbers_beyond_64_bits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.standard_normal((40, 3)) * 1e12).astype(np.float32))]
    got = whitening.whiten(table(spark, rows)).collect()
    assert max(r.deviation for r in got) > Decimal(1 << 63)
    against(rows, got)
    assert [r.vec_id for r in whitening.whiten(table(spark, [(None, [1.0, 0.0]), (None, [0.0, 0.0])])).collect()] == [None, None]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])])).collect()


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = np.linalg.qr(rng.standard_normal((30, 4)))[0]
    locked, u = u[:, :1], u[:, 1:]
    theta = (u * (a @ u)).sum(axis=0)
    res = a @ u - u * theta
    t = whitening.corrections(lambda b: a @ b, theta, u, res, locked, 60)
    for i in range(3):
        q = np.column_stack((locked, u[:, i]))
        p = np.eye(30) - q @ q.T
        assert np.linalg.norm(p @ (a - theta[i] * np.eye(30)) @ p @ t[:, i] + p @ res[:, i]) < 1e-8 * np.linalg.norm(res[:, i])
        assert np.abs(q.T @ t[:, i]).max() < 1e-10


@pytest.mark.parametrize("size,most", [(64, 256), (300, 60), (300, 256), (5, 256)])
def test_eigenpairs_to_double_precision_in_few_products(size, most):
    rng = np.random.default_rng(size)
    y = rng.standard_normal((4 * size, size)) * 0.97 ** np.arange(size)
    passes = []

    def times(block):
        passes.append(block.shape[1])
        return y.T @ (y @ block)

    e, u = whitening.leading(times, size, 8, most_space=most)
    want = np.linalg.eigvalsh(y.T @ y)[::-1][:8]
    assert np.abs(e - want).max() < 1e-13 * want[0] and np.linalg.norm(y.T @ (y @ u) - u * e, axis=0).max() < 1e-13 * want[0]
    assert len(passes) < 60


def test_query_on_embeddings(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_whitening"](spark, path).collect()
    assert all(r.deviation == r.deviation_exact for r in got)
    against(rows, got)
