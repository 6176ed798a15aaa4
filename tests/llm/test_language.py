import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from speechgrid.llm import language as L


def model_of(texts_by_lang, order=3, alphabet="abcdeé"):
    table = L.Model(order, [], alphabet, [], []).table()
    levels = []
    for texts in texts_by_lang.values():
        keys, n = np.unique(L.ngrams(texts, table, order)[0], return_counts=True)
        levels.append(L.kneser_ney(keys, n, order, len(alphabet) + 2))
    return L.merge(list(texts_by_lang), levels, order, alphabet), table


def symbols(text, alphabet):
    out = []
    for c in text.lower():
        x = alphabet.index(c) + 2 if c in alphabet else int(c.isalpha())
        if x or (out and out[-1]):
            out.append(x)
    if out and out[-1] and text:
        out.append(0)
    return out


def slow_grams(text, alphabet, order):
    s = [0] * (order - 1) + symbols(text, alphabet)
    return [tuple(s[k - order + 1:k + 1]) for k in range(order - 1, len(s))]


class Slow:
    def __init__(self, grams, order, letters):
        self.letters = letters
        levels = {order: Counter(grams)}
        for n in range(order - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        self.levels, self.order = levels, order
        self.after = {n: defaultdict(dict) for n in levels}
        for n, c in levels.items():
            for g, k in c.items():
                self.after[n][g[:-1]][g[-1]] = k

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / self.letters
        c = self.levels[n]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = self.after[n].get(g[:-1])
        if after is None:
            return self.p(g[1:])
        total = sum(after.values())
        return max(after.get(g[-1], 0) - d, 0) / total + d * len(after) / total * self.p(g[1:])


@pytest.mark.parametrize("seed", range(6))
def test_against_the_definition(seed):
    rng, alphabet, order = random.Random(seed), "abcdeé", 3
    make = lambda chars, n: ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    langs = {"x": make("aabbc  ,", 12), "y": make("cdeé  E", 12)}
    model, table = model_of(langs, order, alphabet)
    slow = [Slow([g for t in texts for g in slow_grams(t, alphabet, order)], order, len(alphabet) + 2) for texts in langs.values()]
    texts = make("abcdeézZ ,.\n", 20) + ["", " ", "ß", "a", ", a"]
    ce, sizes = L.cross_entropies(model, table, texts)
    for t, row, n in zip(texts, ce, sizes, strict=True):
        grams = slow_grams(t, alphabet, order)
        assert n == len(grams)
        for got, s in zip(row, slow, strict=True):
            want = -sum(math.log(s.p(g)) for g in grams) / max(1, len(grams))
            assert got == pytest.approx(want, rel=1e-4, abs=1e-5)
    for s in slow:
        for context in s.after[order]:
            assert sum(s.p((*context, c)) for c in range(len(alphabet) + 2)) == pytest.approx(1)


def test_sorted_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    h = L.SortedHash(keys)
    asked = np.concatenate((keys, rng.integers(0, 1 << 40, 5000, dtype=np.uint64)))
    rows = h.find(asked)
    assert (keys[h.order][rows[:len(keys)]] == keys).all()
    assert ((rows[len(keys):] >= 0) == np.isin(asked[len(keys):], keys)).all()


def test_long_texts_are_scored_whole(monkeypatch):
    model, table = model_of({"x": ["abc abd"], "y": ["cde ced"]})
    texts = ["abc de " * 50, "", "é a", "b" * 100]
    want = L.cross_entropies(model, table, texts)
    monkeypatch.setattr(L, "_CHUNK", 16)
    got = L.cross_entropies(model, table, texts)
    assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all()


def test_identify(spark, docs_of):
    rng = random.Random(4)
    words = {"en": ["the", "and", "with", "that", "ing"], "de": ["der", "und", "nicht", "schön", "zu"]}
    rows = [(i, lang, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 60)))) for i, lang in enumerate(["en", "de"] * 200)]
    known = spark.createDataFrame([*rows, (900, None, "the"), (901, "en", None), (None, "de", "und der")], "doc_id long, lang string, text string")
    model = L.learn(known, order=4)
    assert model.languages == ["de", "en"]
    texts = [(1, "The, AND with that"), (2, None), (3, ""), (4, "123 !?"), (5, "nicht schön und zu " * 40_000), (5, "der und"), (None, "that"), (6, "qjxkv zzzqqq ххй " * 300)]
    got = {(r.doc_id, r.letters): r for r in L.identify(docs_of(texts), model).collect()}
    by = {k[0]: r for k, r in got.items() if k[1] != 8}
    assert {k: r.lang_pred for k, r in by.items()} | {6: ""} == {1: "en", 2: "und", 3: "und", 4: "und", 5: "de", None: "en", 6: ""}
    assert [by[i].score for i in (2, 3, 4)] == [0, 0, 0] and all(0 <= r.score <= 1 for r in got.values())
    assert {i for i, r in by.items() if r.rejected} == {2, 3, 4, 6}
    assert len(got) == len(texts) and L.identify(docs_of([]), model).count() == 0
    assert L.learn(known.filter("false")) is None
    assert [r.lang_pred for r in L.identify(docs_of([(1, "x")]), None).collect()] == ["und"]


def test_held_out_accuracy(spark):
    from speechgrid.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.op1_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.95 and not any(r.rejected for r in got)
