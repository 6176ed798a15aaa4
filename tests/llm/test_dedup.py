import random

import numpy as np
import pytest
import xxhash

from speechgrid.llm import simhash
from speechgrid.llm.components import components
from speechgrid.llm.exact_dedup import Trie, exact_dedup


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_trie_holds_whole_strings():
    rng, trie, want = random.Random(3), Trie(), {}
    for _ in range(4000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        node = trie.at(key)
        node[2] = (key, (node[2] or (key, 0))[1] + 1)
        want[key] = want.get(key, 0) + 1
    assert dict(trie.values()) == want
    assert all(trie.at(k)[2] == (k, n) for k, n in want.items())


def test_exact_dedup(docs_of):
    rows = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (9, "x" * 299_999 + "y"), (9, "x" * 299_999 + "y"), (None, "ab"), (None, "alone")]
    got = {(r.doc_id, r.group_size): r for r in exact_dedup(docs_of(rows), keep="max").collect()}
    assert {k: (r.keep_id, r.kept) for k, r in got.items()} == {
        (1, 3): (2, False), (2, 3): (2, True), (None, 3): (2, False), (3, 1): (3, True), (4, 1): (4, True), (5, 2): (6, False), (6, 2): (6, True), (7, 2): (8, False),
        (8, 2): (8, True), (9, 2): (9, True), (None, 1): (None, True)}
    assert by_id(exact_dedup(docs_of(rows)))[2].keep_id == 1
    assert exact_dedup(docs_of([])).count() == 0


def slow_print(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "a", "a b", "A b c", "a b c d", "é\x0b ü c d e f", "x y " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 3) % (1 << 64) == slow_print(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots_of(points, distance):
    root = list(range(len(points)))
    for i, a in enumerate(points):
        for j in range(i):
            if bin((a ^ points[j]) % (1 << 64)).count("1") <= distance and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for k, r in enumerate(root):
        best[r] = min(best.get(r, points[k]), points[k])
    return [best[r] for r in root]


@pytest.mark.parametrize("distance,crowd,parts", [(2, 512, 3), (2, 3, 3), (1, 3, 2), (2, 512, 2), (2, 4, 4)])
def test_links_connect_what_brute_force_connects(spark, distance, crowd, parts):
    rng, points = random.Random(distance * 10 + crowd), set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            points.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    points = sorted(signed(p) for p in points)
    fps = spark.createDataFrame([(p,) for p in points], "fp long")
    links = simhash.near_links(fps, distance, parts, crowd)
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= distance for r in links.collect())
    found = {r.node: r.root for r in components(links).collect()}
    assert [found.get(p, p) for p in points] == roots_of(points, distance)


def test_thresholds_are_the_cheapest():
    cost = [[0, 5, 9], [0, 100, 101], [0, 7, 90]]
    assert simhash.thresholds(cost, 2) == [1, -1, 0]
    assert sum(simhash.thresholds([[0, 1, 2]] * 4, 2)) == -1
    groups = simhash.bit_parts(np.eye(64) * 50, 100, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {21, 22}


def test_simhash_groups(docs_of):
    rows = [(5, "a b c d"), (3, "A  b c d"), (9, None), (8, ""), (2, "q r s t u v w x y z " * 20), (1, "other words entirely here"), (None, "a b c d"), (None, "null only words"), (4, "w " * 100_000)]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(docs_of(rows)).collect()}
    by = {i: c for (i, _), c in got.items() if i is not None}
    assert by == {5: 3, 3: 3, 9: 8, 8: 8, 2: 2, 1: 1, 4: 4}
    assert sorted((c for (i, _), c in got.items() if i is None), key=str) == [3, None]
    assert got[(8, "0" * 16)] == 8
    assert simhash.simhash_groups(docs_of([])).count() == 0
