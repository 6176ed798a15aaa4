"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in its features; that a document labelled good beats one labelled bad has the logistic probability
of the difference of their strengths. The weights minimise the logistic loss over preference pairs' feature differences. The cut
is the quantile of the fitted documents' strengths at the share of bad ones, and the score is a logistic curve through a half there.

Every labelled row takes part in the fit: means, weights, cut and slope are sums over all of them. Rows are dealt by a hash of the id
into buckets of about ``RARER`` rows of the rarer label, and every good row of a bucket is preferred to every bad one; with few rows
there is one bucket, so these are all pairs. A Newton step is a pass over the buckets; what comes to the driver is sums whose size is
that of the features. Every text is scored whole. Features are rates over the whole text: of each byte, of word lengths, of repeated
words and lines.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import by_batch, by_slices, id_and_text, utf8

#: Word lengths in bytes counted apart; longer ones together.
LENGTHS = 24
N_FEATURES = 256 + LENGTHS + 8
#: Rows of the rarer label a bucket holds on average, and most rows of the other label that meet them in one block.
RARER, BLOCK = 64, 512
#: Slopes the logistic curve through the cut is chosen from.
SLOPES = np.geomspace(0.05, 20, 60)


def features(text: bytes) -> np.ndarray:
    """Rates, the larger ones damped by a square root; all zero for an empty text."""
    out = np.zeros(N_FEATURES)
    n = len(text)
    if not n:
        return out
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    out[:256] = np.sqrt(hist / n)
    words = text.split()
    k = len(words)
    if k:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=k)
        out[256:256 + LENGTHS] = np.sqrt(np.bincount(np.minimum(sizes, LENGTHS) - 1, minlength=LENGTHS) / k)
        out[-8] = min(sizes.mean(), 50.0) / 10
        out[-7] = len(set(words)) / k
        out[-6] = np.log1p(k) / 10
    lines = [x for x in text.split(b"\n") if x.strip()]
    if lines:
        out[-5] = 1 - len(set(lines)) / len(lines)
        out[-4] = np.log1p(n / len(lines)) / 10
    marks = n - hist[0x30:0x3A].sum() - hist[0x41:0x5B].sum() - hist[0x61:0x7B].sum() - hist[0x80:].sum() - hist[0x20] - hist[9:14].sum()
    upper, lower = hist[0x41:0x5B].sum(), hist[0x61:0x7B].sum()
    out[-3] = marks / n
    out[-2] = upper / max(1, upper + lower)
    out[-1] = hist[0x30:0x3A].sum() / n
    return out


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-self.slope * (self.strength(x) - self.cut), -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int, ridge: float, steps: int = 30, seed: int = 7, many: np.ndarray | None = None) -> Ranker:
    """The fit for rows in memory. Weights from ``pairs`` preferences of a good row over a bad one, drawn evenly from both, by Newton steps. ``many`` says how many
    documents each row stands for: the cut is the quantile of all their strengths at the share of bad ones."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    model = Ranker(mean, spread, np.zeros(x.shape[1]))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        # nothing to prefer: everything is as good as what was seen
        model.cut = -1.0 if len(good) else 1.0
        return model
    rng, z = np.random.default_rng(seed), (x - mean) / spread
    d = z[good[rng.permutation(np.arange(pairs) % len(good))]] - z[bad[rng.permutation(np.arange(pairs) % len(bad))]]
    w = model.weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    many, s = np.ones(len(x)) if many is None else many, model.strength(x)
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(many[order].cumsum(), many[bad].sum() * (1 - 1e-9))) + 1
    model.cut = float((s[order[at - 1]] + s[order[min(at, len(s) - 1)]]) / 2)
    model.slope = _slope(s - model.cut, y, many)
    return model


def _slope(s: np.ndarray, y: np.ndarray, many: np.ndarray) -> float:
    """The steepness that makes the logistic curve through the cut likeliest."""
    return _steepest(_losses(s, y, many))


def _losses(s: np.ndarray, y: np.ndarray, many: np.ndarray | float = 1.0) -> np.ndarray:
    """The logistic loss of every slope."""
    return np.array([(np.logaddexp(0, np.where(y == 1, -a * s, a * s)) * many).sum() for a in SLOPES])


def _steepest(losses: np.ndarray) -> float:
    return float(SLOPES[np.argmin(losses + 0.01 * SLOPES**2)])


def _measure():
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(features(t).tobytes(), 1) for t in utf8(b.column(1))], pa.binary())], names=["doc_id", "x"])
    return each


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, common, x) in this order become blocks: the bucket's rows of the rarer label with some of the other's. ``fresh``:
    the rarer ones are in no block before."""
    at, rare, common, fresh = None, [], [], True

    def block() -> pa.RecordBatch:
        packed = [zlib.compress(b"".join(zlib.decompress(x) for x in side), 1) for side in (rare, common)]
        return pa.RecordBatch.from_arrays([pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary()), pa.array([fresh])], names=["rare", "common", "fresh"])

    for b in batches:
        for bucket, is_common, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at is not None and (bucket != at or len(common) == BLOCK):
                yield block()
                common, fresh = [], bucket != at
                rare = [] if fresh else rare
            at = bucket
            (common if is_common else rare).append(x)
    if at is not None:
        yield block()


def _rows(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed)).reshape(-1, N_FEATURES)


def _sums(parts: DataFrame, width: int) -> np.ndarray:
    """Rows (i, v) of all tasks added up by i."""
    added = F.aggregate(F.collect_list("v"), F.array_repeat(F.lit(0.0), width), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return np.array([r.v for r in sorted(parts.groupBy("i").agg(added.alias("v")).collect(), key=lambda r: r.i)])


def _total(blocks: DataFrame, make: Callable[[np.ndarray, np.ndarray, bool], np.ndarray], width: int) -> np.ndarray:
    """The sum over all blocks of ``make(rare, common, fresh)``, a matrix: partial sums a task, added up by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for rare, common, fresh in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = make(_rows(rare), _rows(common), fresh)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])
    return _sums(blocks.mapInArrow(run, "i int, v array<double>"), width)


def _moments(rare: np.ndarray, common: np.ndarray, fresh: bool) -> np.ndarray:
    """Sums and sums of squares, and in the last column the pairs."""
    x = np.concatenate([rare, common]) if fresh else common
    return np.column_stack([np.array([x.sum(axis=0), (x * x).sum(axis=0)]), [len(rare) * len(common), 0.0]])


def _pair_loss(weights: np.ndarray, spread: np.ndarray, good_is_rare: bool):
    """The loss of a block's pairs, its gradient in the last column and its second derivatives."""
    def make(rare: np.ndarray, common: np.ndarray, fresh: bool) -> np.ndarray:
        good, bad = (rare / spread, common / spread) if good_is_rare else (common / spread, rare / spread)
        d = (good @ weights)[:, None] - (bad @ weights)[None, :]
        p = 1 / (1 + np.exp(np.clip(d, -30, 30)))
        v = p * (1 - p)
        cross = good.T @ (v @ bad)
        out = np.zeros((N_FEATURES + 1, N_FEATURES + 1))
        out[:-1, :-1] = (good.T * v.sum(axis=1)) @ good + (bad.T * v.sum(axis=0)) @ bad - cross - cross.T
        out[:-1, -1] = good.T @ p.sum(axis=1) - bad.T @ p.sum(axis=0)
        out[-1, -1] = np.logaddexp(0, -d).sum()
        return out
    return make


def _fit(blocks: DataFrame, spread: np.ndarray, pairs: float, good_is_rare: bool, ridge: float, steps: int) -> np.ndarray:
    """The weights of least loss, by Newton steps; one that does not lessen it is halved."""
    w, last, step = np.zeros(N_FEATURES), np.inf, np.zeros(N_FEATURES)
    for _ in range(steps):
        t = _total(blocks, _pair_loss(w, spread, good_is_rare), N_FEATURES + 1) / pairs
        loss = t[-1, -1] + ridge / 2 * w @ w
        if loss > last * (1 + 1e-12):
            step = step / 2
            w = w - step
            continue
        last = loss
        step = np.linalg.solve(t[:-1, :-1] + ridge * np.eye(len(w)), t[:-1, -1] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _strengths(model: Ranker, good_is_rare: bool):
    """Rows (y, key) of every labelled row once; ``key`` is the strength's bits as a long of the same order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rare, common, fresh in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for y, packed in ((int(good_is_rare), rare if fresh else b""), (int(not good_is_rare), common)):
                    if packed:
                        bits = (model.strength(_rows(packed)) + 0.0).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), y, dtype=np.int32)), pa.array(_flip(bits))], names=["y", "key"])
    return run


def _flip(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _strength(key: int) -> float:
    return float(_flip(np.array([key], dtype=np.int64)).view(np.float64)[0])


def _at_rank(keys: DataFrame, rank: int) -> int:
    """The key of this rank (from 1), found 16 bits at a time."""
    top = None
    for shift in (48, 32, 16, 0):
        part = keys if top is None else keys.filter(F.shiftright("key", shift + 16) == top)
        for r in sorted(part.groupBy(F.shiftright("key", shift).alias("top")).count().collect(), key=lambda r: r.top):
            if rank <= r["count"]:
                top = r.top
                break
            rank -= r["count"]
    return top


def _slopes(cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SLOPES))
        for b in batches:
            total += _losses(_flip(np.array(b.column(1))).view(np.float64) - cut, np.array(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["i", "v"])
    return run


def learn(docs: DataFrame, labels: DataFrame, ridge: float = 0.003, steps: int = 40, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker | None:
    """A ranker from all labelled documents; the cut is the quantile of all their strengths at the share of bad ones.
    A document labelled more than once counts as good if most of its labels say so; labels other than 0 and 1 are none; repeated rows
    count each. None without a labelled document.

    The features, not the texts, are joined with the labels, so no text is shuffled and no label is broadcast by hint."""
    votes = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    measured = id_and_text(docs, id_col, text_col).mapInArrow(by_slices(_measure), "doc_id long, x binary")
    rows = stage(measured.join(votes, "doc_id"))
    found = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not found:
        return None
    good, bad = found.get(1, 0), found.get(0, 0)
    good_is_rare = good < bad
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, min(good, bad) // RARER))).alias("bucket")
    dealt = rows.select(bucket, (F.col("y") != int(good_is_rare)).alias("common"), "x", "doc_id").repartition("bucket").sortWithinPartitions("bucket", "common", "doc_id")
    blocks = stage(dealt.select("bucket", "common", "x").mapInArrow(_blocks, "rare binary, common binary, fresh boolean"))
    sums = _total(blocks, _moments, N_FEATURES + 1)
    mean = sums[0, :-1] / (good + bad)
    model = Ranker(mean, np.maximum(np.sqrt(np.maximum(sums[1, :-1] / (good + bad) - mean**2, 0)), 0.02), np.zeros(N_FEATURES))
    if not good or not bad:
        # nothing to prefer: everything is as good as what was seen
        model.cut = -1.0 if good else 1.0
        return model
    model.weights = _fit(blocks, model.spread, sums[0, -1], good_is_rare, ridge, steps)
    keys = stage(blocks.mapInArrow(_strengths(model, good_is_rare), "y int, key long"))
    low = _at_rank(keys, bad)
    r = keys.agg(F.count_if(F.col("key") <= low).alias("n"), F.min(F.when(F.col("key") > low, F.col("key"))).alias("next")).first()
    model.cut = (_strength(low) + _strength(low if r.n > bad else r.next)) / 2
    model.slope = _steepest(_sums(keys.mapInArrow(_slopes(model.cut), "i int, v array<double>"), len(SLOPES))[0])
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(pickled: bytes | None):
    model = pickle.loads(pickled) if pickled else None

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(np.array([features(t) for t in utf8(b.column(1))])) if model else np.full(b.num_rows, 0.5)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=_OUT)
    return each


def quality_scores(docs: DataFrame, model: Ranker | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, score`` (0 to 1, higher: the good label likelier) and ``predicted`` (1 from a half up).

    A null text is empty; empty texts have no rates and get the model's score of that. Without a model all scores are a half. A null
    id is kept. Repeated rows each get a row. Other columns are ignored. No rows give no rows."""
    return id_and_text(docs, id_col, text_col).mapInArrow(by_batch(_score, pickle.dumps(model) if model else None), "doc_id long, score double, predicted int")
