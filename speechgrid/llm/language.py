"""Language identification with interpolated Kneser-Ney character models.

One model a language: the n-grams of lower-cased letters (all else is one space between words) with interpolated Kneser-Ney
probabilities, the lower orders from how many different characters stand before an n-gram. Models are kept as sorted arrays of
hashed n-grams; for scoring those of all languages are merged into one array an order, whose rows hold every language's value with
backing off already done, so a character costs one look-up however many languages there are. A text goes to the language of the
lowest cross-entropy a character. Labelled rows that the counts did not see set the confidence scale and the limits beyond which a
text is rejected as no known language.

The counts come from a bounded sample of labelled rows (``fit_rows`` a language); every text is scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, by_slices, id_and_text

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


class SortedHash:
    """A set of 64-bit keys as a sorted array of their hashes (the mixing has an inverse, so no two keys share one), entered by
    the first bits of the hash."""

    def __init__(self, keys: np.ndarray):
        h = keys.astype(np.uint64) * _MIX
        self.order = np.argsort(h)
        self.hashes = np.append(h[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(1, int(np.log2(len(keys) + 1)) + 2)
        self.start = np.searchsorted(self.hashes[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key in the order of the hashes, -1 if it is none."""
        h = keys * _MIX
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        held = self.hashes[at]
        todo = np.flatnonzero(held < h)
        while len(todo):
            at[todo] += 1
            more = self.hashes[at[todo]]
            held[todo] = more
            todo = todo[more < h[todo]]
        at[held != h] = -1
        at[at == len(self.hashes) - 1] = -1
        return at


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def kneser_ney(keys: np.ndarray, counts: np.ndarray, order: int, letters: int) -> list[dict]:
    """From the counts of the highest order: per order 1 .. ``order`` the n-grams with their log probabilities and the contexts
    with their log back-off weights, all sorted by key."""
    levels = [(keys, counts.astype(np.float64))]
    for n in range(order - 1, 0, -1):
        lower, cont = np.unique(levels[0][0] & _mask(n), return_counts=True)
        levels.insert(0, (lower, cont.astype(np.float64)))
    out, p = [], None
    for n, (k, c) in enumerate(levels, 1):
        context, which = np.unique(k >> np.uint64(8), return_inverse=True)
        total = np.bincount(which, weights=c)
        kinds = np.bincount(which)
        ones, twos = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        back = discount * kinds / total
        lower = np.full(len(k), 1.0 / letters) if n == 1 else p[np.searchsorted(levels[n - 2][0], k & _mask(n - 1))]
        p = np.maximum(c - discount, 0) / total[which] + back[which] * lower
        out.append({"keys": k, "logp": np.log(p), "contexts": context, "back": np.log(back)})
    return out


@dataclass
class Model:
    order: int
    languages: list[str]
    alphabet: str
    grams: list[tuple[SortedHash, np.ndarray]]
    contexts: list[tuple[SortedHash, np.ndarray]]
    scale: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def table(self) -> np.ndarray:
        t = _letters().copy()
        t[np.array([ord(c) for c in self.alphabet], dtype=np.int64)] = np.arange(2, len(self.alphabet) + 2)
        return t


_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """1 for letters, 0 for all else, by code point."""
    global _LETTERS
    if _LETTERS is None:
        t = np.zeros(0x110000, dtype=np.uint8)
        t[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = 1
        _LETTERS = t
    return _LETTERS


def ngrams(texts: list[str], table: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all n-grams of the texts, one a character, and where each text's begin. Texts begin and end with a space that
    counts as their context."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in low])
    a = table[np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = a == 0
    keep = ~space
    keep[1:] |= ~space[:-1]
    starts = np.concatenate(([0], ends[:-1]))
    keep[starts] = ~space[starts]  # a space at the beginning is context already
    first = np.concatenate(([0], np.cumsum(keep)))[starts]
    a = a[keep].astype(np.uint64)
    keys = a.copy()
    for d in range(1, order):
        keys[d:] |= a[:-d] << np.uint64(8 * d)
    size = len(a)
    stops = np.concatenate((first[1:], [size]))
    for d in range(order - 1):
        here = (first + d)[first + d < stops]
        keys[here] &= _mask(d + 1)
    return keys, np.concatenate((first, [size]))


def log_probs(model: Model, keys: np.ndarray) -> np.ndarray:
    """Per key and language the log probability of its last character."""
    out = np.zeros((len(keys), len(model.languages)), dtype=np.float32)
    todo = np.arange(len(keys))
    for n in range(model.order, 0, -1):
        mine = keys[todo] & _mask(n)
        hashed, values = model.grams[n - 1]
        at = hashed.find(mine)
        hit = at >= 0
        if n == model.order:
            out[hit] = values[at[hit]]
        else:
            out[todo[hit]] += values[at[hit]]
        todo = todo[~hit]
        if not len(todo):
            return out
        hashed, values = model.contexts[n - 1]
        at = hashed.find(mine[~hit] >> np.uint64(8))
        known = at >= 0
        out[todo[known]] += values[at[known]]
    out[todo] += np.float32(-np.log(len(model.alphabet) + 2))
    return out


def cross_entropies(model: Model, table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language the mean of -log p, and per text the number of characters counted (0: no letter)."""
    out, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), dtype=np.int64)
    k = 0
    while k < len(texts):
        e, held = k, 0
        while e < len(texts) and (e == k or held + len(texts[e]) <= _CHUNK):
            held += len(texts[e])
            e += 1
        keys, first = ngrams(texts[k:e], table, model.order)
        for s in range(0, len(keys), 4 * _CHUNK):  # one very long text
            lp = log_probs(model, keys[s:s + 4 * _CHUNK])
            total = np.concatenate((np.zeros((1, lp.shape[1])), np.cumsum(lp, axis=0, dtype=np.float64)))
            edge = np.clip(first - s, 0, len(lp))
            out[k:e] -= total[edge[1:]] - total[edge[:-1]]
        sizes[k:e] = np.diff(first)
        k = e
    out /= np.maximum(sizes, 1)[:, None]
    return out, sizes


def merge(languages: list[str], levels: list[list[dict]], order: int, alphabet: str) -> Model:
    """One array an order for all languages, every row with all their values."""
    grams, contexts, before = [], [], None
    for n in range(1, order + 1):
        union = np.unique(np.concatenate([m[n - 1]["keys"] for m in levels]))
        values = np.empty((len(union), len(languages)))
        for i, m in enumerate(levels):
            mine = m[n - 1]
            if n == 1:
                values[:, i] = -np.log(len(alphabet) + 2) + mine["back"][0]
            else:
                values[:, i] = before[1][np.searchsorted(before[0], union & _mask(n - 1)), i]
                c = union >> np.uint64(8)
                at = np.minimum(np.searchsorted(mine["contexts"], c), len(mine["contexts"]) - 1)
                values[:, i] += np.where(mine["contexts"][at] == c, mine["back"][at], 0)
            values[np.searchsorted(union, mine["keys"]), i] = mine["logp"]
        c = np.unique(np.concatenate([m[n - 1]["contexts"] for m in levels]))
        back = np.zeros((len(c), len(languages)))
        for i, m in enumerate(levels):
            back[np.searchsorted(c, m[n - 1]["contexts"]), i] = m[n - 1]["back"]
        before = (union, values)
        for keys, rows, into in ((union, values, grams), (c, back, contexts)):
            hashed = SortedHash(keys)
            into.append((hashed, rows[hashed.order].astype(np.float32)))
    return Model(order, languages, alphabet, grams, contexts)


_COUNT = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])


def _count(alphabet: str, order: int):
    table = Model(order, [], alphabet, [], []).table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lang in sorted(set(langs)):
                keys, n = np.unique(ngrams([t for x, t in zip(langs, texts, strict=True) if x == lang], table, order)[0], return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=_COUNT)
    return run


def _char_counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, n = np.unique(np.frombuffer("".join(t.lower() for t in b.column(2).to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int64)), pa.array(n.astype(np.int64))], names=["point", "n"])
    return run


def learn(labelled: DataFrame, order: int = 5, fit_rows: int = 600, most_languages: int = 256, letters: int = 200, limit: float = 16.0,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the languages named in ``lang_col`` (the ``most_languages`` most frequent; rows without text or language are left
    out), counted on about ``fit_rows`` rows of each, chosen by a hash of the id; a fifth of them sets the confidence scale and the
    rejection limit of ``limit`` deviations. None if there is nothing to learn from. The sample, and so what comes to the driver, is
    bounded by these parameters: at most about ``fit_rows * most_languages`` texts' distinct n-grams."""
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(
        "lang is not null and text is not null and text <> ''")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not found:
        return None
    rate = F.create_map(*[F.lit(x) for r in found for x in (r.lang, float(fit_rows) / r["count"])])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.withColumn("drawn", drawn).filter(F.col("drawn") < rate[F.col("lang")])
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))
    fit = sample.filter(fold > 0).select("doc_id", "lang", "text")
    chars = fit.mapInArrow(_char_counts(), "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(4 * letters).collect()
    alphabet = "".join(c for r in chars if (c := chr(r.point)).isalpha())[:letters]
    counted = fit.mapInArrow(_count(alphabet, order), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return None
    levels = []
    for lang in languages:
        mine = counted[counted["lang"] == lang]
        keys = mine["key"].to_numpy().view(np.uint64) if mine["key"].to_numpy().flags.c_contiguous else np.ascontiguousarray(mine["key"].to_numpy()).view(np.uint64)
        by = np.argsort(keys)
        levels.append(kneser_ney(keys[by], mine["n"].to_numpy()[by], order, len(alphabet) + 2))
    model = merge(languages, levels, order, alphabet)
    model.mean, model.spread = np.zeros(len(languages)), np.ones(len(languages))
    held = sample.filter(fold == 0).select("doc_id", "lang", "text").mapInArrow(
        by_batch(_measure, pickle.dumps(model)), "lang string, n long, ce array<double>").filter("n > 0").collect()
    _calibrate(model, [(languages.index(r.lang), r.n, np.array(r.ce)) for r in held if r.lang in languages], limit)
    return model


def _measure(pickled: bytes):
    model = pickle.loads(pickled)
    table = model.table()

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        ce, sizes = cross_entropies(model, table, b.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes), pa.array(list(ce), pa.list_(pa.float64()))], names=["lang", "n", "ce"])
    return each


def _calibrate(model: Model, held: list[tuple[int, int, np.ndarray]], limit: float) -> None:
    """``scale`` turns differences of total log probability into confidences of the best likelihood on the held rows. A text is
    rejected beyond ``mean + limit * spread``, both of the held rows' own cross-entropy by language, the spread widened for short
    texts by the root of their length."""
    best = -np.inf
    for scale in (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0):
        got = 0.0
        for own, n, ce in held:
            x = -ce * n * scale
            got += x[own] - (m := x.max()) - np.log(np.exp(x - m).sum())
        if got > best + 1e-9:
            best, model.scale = got, scale
    everything = np.array([ce[own] for own, _, ce in held]) if held else np.array([3.0])
    for i in range(len(model.languages)):
        own = np.array([ce[i] for o, _, ce in held if o == i])
        own = own if len(own) >= 10 else everything
        model.mean[i] = own.mean()
        model.spread[i] = limit * max(own.std(), 0.1)


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64()), ("letters", pa.int64())])


def _predict(pickled: bytes | None):
    model = pickle.loads(pickled) if pickled else None
    table = model.table() if model else None

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        if model is None:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([True] * n), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())], schema=_OUT)
        ce, sizes = cross_entropies(model, table, b.column(1).to_pylist())
        pick = ce.argmin(axis=1)
        low = ce[np.arange(n), pick]
        x = -(ce - low[:, None]) * sizes[:, None] * model.scale
        score = 1 / np.exp(np.maximum(x, -700)).sum(axis=1)
        none = sizes == 0
        # a short text strays more: the limit widens with the root of its length
        over = low > model.mean[pick] + model.spread[pick] * (1 + 10 / np.sqrt(np.maximum(sizes, 1)))
        names = np.array([*model.languages, UNKNOWN], dtype=object)[np.where(none, len(model.languages), pick)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(none | over),
                                           pa.array(low, mask=none), pa.array(sizes.astype(np.int64))], schema=_OUT)
    return each


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, lang_pred`` (``und`` without a letter, or without a model), ``score`` (0 to 1, the confidence in
    it; 0 for ``und``), ``rejected`` (no letter, or a cross-entropy no known language has), ``cross_entropy`` (null for ``und``) and
    ``letters`` (the characters scored).

    A null text is empty. A null id is kept. Equal scores go to the language first in order. Repeated rows each get a row. Other
    columns are ignored. No rows give no rows."""
    return id_and_text(docs, id_col, text_col).mapInArrow(
        by_batch(_predict, pickle.dumps(model) if model else None), "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double, letters long")


def _accept(pickled: bytes | None, at: int):
    predict = _predict(pickled)

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        text = b.column(at).fill_null("")
        return b.filter(pa.compute.invert(predict(pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), text], names=["doc_id", "text"])).column(3)))
    return each


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not ``rejected`` by ``identify``."""
    return docs.mapInArrow(by_slices(_accept, pickle.dumps(model) if model else None, docs.columns.index(text_col)), docs.schema)
