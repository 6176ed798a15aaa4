import random
import re
import zlib
from collections import Counter

import pytest

from speechgrid.llm import queries, spelling

LETTERS = "abcdefghijklmnopqrstuvwxyzÀÉéßñ÷"


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1:] == b[k + (len(a) == len(b)):]


def plain(docs, shortest=7, every=31, commoner=10):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= shortest
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= commoner * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out.append((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def family(rng, words, size):
    out = []
    for _ in range(size):
        w = rng.choice(words)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(LETTERS) + w[k:], w[:k] + rng.choice(LETTERS) + w[k + 1:]])
        out.append(w if rng.random() < 0.8 else w.upper())
    return " ".join(out)


@pytest.mark.parametrize("symbols", [1, 3, None])
def test_as_all_pairs(spark, docs_of, symbols):
    rng = random.Random(5)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(6, 14))) for _ in range(25)]
    docs = [(i, family(rng, words, rng.randrange(300))) for i in range(60)] + [(60, None), (61, ""), (62, "... 12"), (None, family(rng, words, 200)), (5, family(rng, words, 50))]
    want = plain(docs)
    assert sum(r[1] is not None for r in want) > 50
    assert got(spelling.spelling_variants(docs_of(docs), every=31, symbols=symbols)) == want


def test_chains_ties_and_empty(spark, docs_of):
    # each form is ten times as common as the word before; of two forms as common the smaller wins
    text = " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000 + ["zzzzzzzz"] * 2 + ["zzzzzzzy"] * 20 + ["zzzzzzzx"] * 20)
    rows = {r[0]: r[1:] for r in got(spelling.spelling_variants(docs_of([(1, text)])))}
    assert rows["abcdefg"] == ("abcdefgh", "abcdefghij", 2, 1, 20) and rows["abcdefghij"] == (None, "abcdefghij", 2000, 1, None)
    assert rows["zzzzzzzz"] == ("zzzzzzzx", "zzzzzzzx", 2, 2, 20)
    assert got(spelling.spelling_variants(docs_of([]))) == [] == got(spelling.spelling_variants(docs_of([(1, None), (2, "once only here")])))


def test_very_long_words(spark, docs_of):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    cut = long[:150_000] + long[150_001:]
    rows = got(spelling.spelling_variants(docs_of([(1, f"{long} {cut} " + "aaaaaaaa " * 20_000), (2, f"{long} {cut} " + "aaaaaaaaa " * 2)])))
    assert sorted((len(r[0]), r[4]) for r in rows) == [(8, 1), (9, 1), (299_999, 1), (300_000, 1)]


def test_keys_are_those_of_spelled_out_neighbours():
    k = spelling.Keys(3)
    for word in ("abcabca", "aabbcc", "ccccccc", "a"):
        s = k.numbers(word)
        want = {word} | {word[:i] + word[i + 1:] for i in range(len(word))} | {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in "abc" if c > word[i]}
        some = [x for part in k.neighbours(s, wide=2) for x in part.tolist()]
        assert len(some) == len(set(some)) and set(some) == {int(k.key(k.numbers(w))) for w in want}


def test_query_on_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op13_spelling_variants"](spark, path)) == plain(docs)
