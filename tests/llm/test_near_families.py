import random

import numpy as np

from speechgrid.llm import near_copies
from speechgrid.llm.simhash import shingle_hashes


def connected(texts, least=0.8):
    """The smallest index reachable over pairs of at least ``least``, by all pairs."""
    sets = [np.unique(shingle_hashes(t.encode(), 5)) for t in texts]
    every = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    held = np.zeros((len(sets), len(every)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [every[h] for h in s.tolist()]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    near = both / (n[:, None] + n[None] - both) >= least
    root = np.arange(len(sets))
    while True:
        low = np.where(near, root[None], len(sets)).min(axis=1)
        if (low == root).all():
            return root.tolist(), near
        root = low


def edits(rng, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for k in rng.sample(range(5, len(words) - 5), changes):
            w[k] = f"e{rng.randrange(10 ** 9)}"
        out.append(" ".join(w))
    return out


def found(docs_of, texts):
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(list(enumerate(texts)))).collect()}
    return [got.get(i, i) for i in range(len(texts))]


def test_hub_with_a_thousand_edits(docs_of):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(304)]
    texts = edits(rng, words, 1000, 6) + [" ".join(words)]
    want, near = connected(texts)
    assert near[-1].sum() > 900 and near[:-1, :-1].sum() < 1100 + 1000 * 30
    assert found(docs_of, texts) == want


def test_pages_of_one_template_hold_a_pair(docs_of):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(304)]
    texts = edits(rng, words, 120, 9)
    texts += edits(rng, texts[70].split(), 3, 4)
    want, near = connected(texts)
    assert 3 <= sum(r != i for i, r in enumerate(want)) < 20
    assert found(docs_of, texts) == want


def test_large_families(docs_of):
    """A hub with thousands of edits, alike to it and seldom to each other, and pages of a template with two copies of one."""
    rng = random.Random(8)
    hub, page = ([f"{c}{rng.randrange(10 ** 6)}" for _ in range(304)] for c in "hp")
    texts = edits(rng, hub, 4_000, 5) + [" ".join(hub)]
    pages = edits(rng, page, 2_000, 9)
    texts += pages + edits(rng, pages[70].split(), 2, 4)
    got = found(docs_of, texts)
    assert got[:4_001] == [0] * 4_001
    assert {got[k] for k in (4_071, 6_001, 6_002)} == {got[4_071]} and got[6_001] != 6_001
    sets = [np.unique(shingle_hashes(t.encode(), 5)) for t in texts[4_001:]]
    every = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    held = np.zeros((len(sets), len(every)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [every[h] for h in s.tolist()]] = 1
    linked = [k - 4_001 for k in range(4_001, len(texts)) if got[k] != k]
    both, n = held[linked] @ held.T, held.sum(axis=1)
    near = both / (n[linked][:, None] + n[None] - both) >= 0.8
    assert all(any(got[4_001 + j] == got[4_001 + k] for j in np.flatnonzero(near[i]).tolist() if j != k) for i, k in enumerate(linked))


def test_blocks_hold_every_pair_that_may_be_alike():
    rng = np.random.default_rng(4)
    sets = []
    for n in (0, 1, 40, 300, 600, 4000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [np.concatenate((x[:int(len(x) * s)], rng.integers(0, 1 << 63, int(n * (1 - s)), dtype=np.uint64))) for s in (1.0, 0.95, 0.9, 0.85, 0.5)]
    bits = [near_copies.sketch(s, near_copies.bits_for(len(s))) for s in sets]
    side = (np.arange(len(sets)), np.arange(len(sets)) // 2, np.array([len(s) for s in sets]), bits)
    got = set(near_copies.survivors(side, side, 0.8))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if i // 2 != j // 2 and (not len(x) + len(y) or both / (len(x) + len(y) - both) >= 0.8):
                assert (i, j) in got
    assert len(got) < len(sets) * 12


def test_sketches_never_drop_a_pair():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 300, 5000):
        for share in (0.5, 0.79, 0.8, 0.81, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.concatenate((x[:int(len(x) * share)], rng.integers(0, 1 << 63, 3, dtype=np.uint64)))
            apart = bin(int.from_bytes(near_copies.sketch(x)) ^ int.from_bytes(near_copies.sketch(y))).count("1")
            assert apart <= len(x) + len(y) - 2 * len(np.intersect1d(x, y))
