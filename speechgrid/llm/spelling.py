"""Spelling variants: words of the corpus one edit apart, and the common form of each rare one.

The words come from whole texts, counted in the map tasks before any shuffle. Their letters are hashed to a few symbols: letters by
falling count, each to the symbol that holds least, so the symbols are about equally common. Of every distinct reduced word the
neighbourhood of one edit is generated: itself, all deletions, all replacements. The relation is symmetric, so each pair is
generated from one end: an insertion is the deletion of the longer word, and a replacement goes from the smaller symbol to the
larger. Neighbours meet the reduced vocabulary by key, and what meets is verified on the original strings.

A neighbour's key is a polynomial hash changed in one place, so no neighbour is spelled out, and a word of a million letters costs
a few million numbers, handed on in bounded batches. Two reduced words of one key only bring candidates more. No key is crowded
however the words are distributed: a key is met by at most the one-edit neighbours of a reduced word. The number of symbols follows
the logarithm of the vocabulary, which keeps the words of a reduced word few, and the candidates of chance in proportion to the
keys; results are the same for any number.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import by_batch, id_and_text, parts_for, utf8

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("near", pa.int64())])
_FIRST = 97  # the code point of symbol 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse among the 64-bit numbers
_INVERSE = pow(_BASE, -1, 1 << 64)


def noisy(doc_id: int | None, run: str, every: int) -> str:
    """The run without one letter if the checksum of id (null: empty) and run says so: the variants planted in a clean corpus."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words_of(doc_id: int | None, text: bytes, shortest: int, every: int) -> Counter:
    """How often each word stands in a text; only A-Z are lower-cased."""
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.lower().decode())).items():
        if len(run) >= shortest:
            word = noisy(doc_id, run, every) if every else run
            if len(word) >= shortest:
                out[word] += n
    return out


def _count(shortest: int, every: int, held: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=_COUNTS)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                seen.update(words_of(doc, text, shortest, every))
                if len(seen) > held:
                    yield out()
                    seen.clear()
        if seen:
            yield out()
    return run


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of at least ``shortest`` letters that stand at least ``least`` times in all texts together. With ``every``
    = k about one distinct run in k of each document loses a letter first (``noisy``)."""
    return (id_and_text(docs, id_col, text_col).mapInArrow(_count(shortest, every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def symbols_for(letters: dict[str, int], words: int, symbols: int | None = None) -> dict[str, int]:
    """The symbol (from 1) of each letter: letters by falling count, each to the symbol that holds least. ``symbols`` of them, or
    as many as the logarithm of the number of words asks for."""
    many = symbols or max(2, math.ceil(math.log2(words + 2) / 2.4))
    load = [0] * many
    out = {}
    for c, n in sorted(letters.items(), key=lambda x: (-x[1], x[0])):
        s = load.index(min(load))
        out[c] = s + 1
        load[s] += n
    return out


class Keys:
    """Keys of reduced words and of their neighbours, as numbers modulo 2 ** 64."""

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.powers = np.ones(1, dtype=np.uint64)

    def _power(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            self.powers = np.concatenate((np.ones(1, np.uint64), np.full(2 * n, _BASE, np.uint64).cumprod(dtype=np.uint64)))
        return self.powers[:n]

    @staticmethod
    def numbers(reduced: str) -> np.ndarray:
        return (np.frombuffer(reduced.encode("utf-32-le"), dtype="<u4") - _FIRST + 1).astype(np.uint64)

    def key(self, s: np.ndarray) -> np.uint64:
        return (s * self._power(len(s))).sum(dtype=np.uint64)

    def neighbours(self, s: np.ndarray, wide: int = 65_536) -> Iterator[np.ndarray]:
        """The keys of the word itself, of its distinct deletions, and of all replacements by a larger symbol, in bounded arrays."""
        p = self._power(len(s))
        terms = s * p
        key, upto = terms.sum(dtype=np.uint64), terms.cumsum(dtype=np.uint64)
        yield np.array([key])
        first = np.ones(len(s), dtype=bool)
        first[1:] = s[1:] != s[:-1]  # of a run of one symbol every deletion is the same
        yield (upto - terms + (key - upto) * np.uint64(_INVERSE))[first]
        for k in range(0, len(s), wide):
            up = np.arange(1, self.symbols, dtype=np.uint64)[None, :] * p[k:k + wide, None]
            yield (key + up)[np.arange(1, self.symbols)[None, :] + s[k:k + wide, None].astype(np.int64) <= self.symbols]


def _keyed(symbols: int):
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        k = Keys(symbols)
        keys = np.array([k.key(k.numbers(r)) for r in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(keys)], names=["word", "n", "key"])
    return each


def _near(symbols: int, most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Keys(symbols)
        keys: list[np.ndarray] = []
        near: list[np.ndarray] = []
        held = 0
        for b in batches:
            for reduced in b.column(0).to_pylist():
                s = k.numbers(reduced)
                key = k.key(s)
                for some in k.neighbours(s):
                    near.append(some)
                    keys.append(np.full(len(some), key))
                    held += len(some)
                    if held > most:
                        yield _key_batch(keys, near)
                        keys, near, held = [], [], 0
        if held:
            yield _key_batch(keys, near)
    return run


def _key_batch(keys: list[np.ndarray], near: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, near)], schema=_KEYS)


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    more = len(a) - len(b)
    if more > 1 or a == b:
        return False
    low, high = 0, len(b)  # how many first letters agree
    while low < high:
        k = (low + high + 1) // 2
        if a[low:k] == b[low:k]:
            low = k
        else:
            high = k - 1
    return a[low + 1:] == b[low + 1 - more:]


def _verified():
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(map(one_edit, b.column(0).to_pylist(), b.column(2).to_pylist()), pa.bool_()))
    return each


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """``a, a_n, b, b_n``: every two words of ``word, n`` (distinct words) that differ by exactly one inserted, deleted or replaced
    code point, once each."""
    spark = words.sparkSession
    letters = {r.c: r.n for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()}
    many = words.count()
    if not many:
        return words.selectExpr("word AS a", "n AS a_n", "word AS b", "n AS b_n")
    symbol = symbols_for(letters, many, symbols)
    most = max(symbol.values())
    reduce = F.translate("word", "".join(symbol), "".join(chr(_FIRST + s - 1) for s in symbol.values()))
    keyed = stage(words.select("word", "n", reduce.alias("reduced")).mapInArrow(by_batch(_keyed, most), "word string, n long, key long"))
    reduced = words.select(reduce.alias("reduced")).distinct().repartition(parts_for(spark, many, 100_000), "reduced")
    keys = reduced.mapInArrow(_near(most), "key long, near long")
    met = keys.join(keyed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("key").alias("near")), "near")
    pairs = met.join(keyed.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key"), "key")
    # words of one reduced word meet twice
    return pairs.filter("key <> near OR a < b").select("a", "a_n", "b", "b_n").mapInArrow(by_batch(_verified), "a string, a_n long, b string, b_n long").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the end of each chain of forms, by doubling. Chains end, as every form is commoner than its word."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, commoner: int = 10, every: int = 0, symbols: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``word_counts``: ``n_near`` words are one edit away; ``form`` is the
    commonest of them (ties: the smallest in code-point order) if it stands at least ``commoner`` times as often as the word, else
    null, and ``form_n`` its count; ``root`` is where the forms of forms end, the word itself without a form.

    A null text has no words. A null id counts as an empty text in ``noisy``. Repeated rows count each. Words and texts may be of
    any length. Other columns are ignored. No rows give no rows."""
    words = stage(word_counts(docs, shortest, least, every, id_col, text_col))
    pairs = near_words(words, symbols)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    known = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.expr(f"-best.m >= {commoner} * n"), F.col("best.near")).alias("form"), F.expr("-best.m").alias("m")))
    roots = last_forms(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("m")).alias("form_n"))
