import itertools
import random

import numpy as np

from speechgrid.operators import linking


def test_assign_is_the_best_and_first_of_equals():
    rng = random.Random(6)
    for _ in range(300):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        gain = [[rng.choice([0, 0, 3, 5, 5, 8]) for _ in range(m)] for _ in range(n)]
        options = [[*(j for j in range(m) if row[j] > 0), m] for row in gain]
        legal = [p for p in itertools.product(*options) if len({j for j in p if j < m}) == sum(j < m for j in p)]
        best = min(legal, key=lambda p: (-sum(gain[i][j] for i, j in enumerate(p) if j < m), p))
        assert linking.assign(gain) == [None if j == m else j for j in best]


def test_pick_pairs_takes_the_best_first():
    score = np.array([[0.9, 0.8], [0.9, np.nan]])
    assert linking.pick_pairs(score, ["b", "a"], ["S1", "S2"]) == {1: 0, 0: 1}
    assert linking.pick_pairs(np.full((2, 0), np.nan), ["a", "b"], []) == {}


def test_walk_raises_beyond_its_bound(spark):
    import pytest

    from speechgrid.functions import scan

    jumps = spark.createDataFrame([(1, i, 12 if i == 3 else 1) for i in range(40)], "m bigint, seq bigint, n int")
    with pytest.raises(Exception, match="a jump outside"):
        scan.walk(jumps, ["m"], "seq", "n", longest=6, size=16).collect()
    assert len(scan.walk(jumps, ["m"], "seq", "n", longest=12, size=16).collect()) == 29
