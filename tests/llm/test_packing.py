import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from speechgrid.llm import packing


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers

    return packing.Tokens(public_tokenizers.path("word_bpe_49k.json"), cached=400)


def library_ids(tokens, text):
    return np.array(tokens.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ids_are_the_library_s(spark, tokens):
    rng = random.Random(2)
    texts = ["", " ", "İx. a", "it's don't ''s x'y l'été", "½ ² ª", "a\x1cb", "ſS ŉ ß ẞ", "<|endoftext|> x", "é́", "\xa0a", "DON'T.--x_y 12a3", "中文", "a\x00b", "'ſ 'S 'LL we'LLx"]
    texts += ["".join(rng.choice("abcdeéÈÿſ'.,-_ \n\t0123ABCstlrvemd") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert tokens.encode(t) == library_ids(tokens, t), t


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng, size = random.Random(seed), 32
    counts = {rng.randint(1, size): rng.randint(1, 60) for _ in range(rng.randint(1, 25))}
    held, ranks = defaultdict(list), Counter()
    for length, rank, n, first, offset in packing.plan_packs(counts, size):
        ranks.update((length, r) for r in range(rank, rank + n))
        for s in range(first, first + n):
            held[s].append((offset, length))
    assert ranks == Counter((k, r) for k, n in counts.items() for r in range(n))
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    assert sorted(held) == list(range(len(held)))


def test_plan_does_not_grow_with_the_corpus():
    counts = {n: 10 ** 9 + n for n in range(1, 513)}
    assert len(packing.plan_packs(counts, 512)) < 5 * 512


@pytest.mark.parametrize("parts", [1, 5])
def test_pack(docs_of, tokens, parts):
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (None, "no id")] + [(k, " ".join(rng.choice(["a", "bc", "the", "x1", "é"]) for _ in range(rng.randint(1, 90)))) for k in range(10, 150)] + [(k, "same text") for k in range(200, 300)]
    got = packing.pack(docs_of(rows).repartition(parts), size=64).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i in {i for i, _ in rows}:
        mine = [t for j, t in rows if j == i]
        ids = library_ids(tokens, mine[0] or "") + (2).to_bytes(4, "little")
        want = [(s, min(64, len(ids) // 4 - s), zlib.crc32(ids[4 * s:4 * (s + 64)]), len(ids) // 4) for s in range(0, len(ids) // 4, 64)] * len(mine)
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in docs[i]) == sorted(want)
    for pieces in seqs.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64
    assert sum(r.length for r in got) / (64 * len(seqs)) > 0.8
    assert packing.pack(docs_of([])).count() == 0
