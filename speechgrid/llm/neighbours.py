"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is halved again and again, each time into two equal parts along the line between two means, until the parts are
as small as a list should be: their means are the centroids of balanced lists. The centroids and a graph of their neighbours are
small enough for every task. A vector finds its nearest centroids by a best-first walk on the graph and goes to the nearest list,
and, as a boundary copy, to others that are nearly as near. A query walks the same graph and reads the lists whose distance is within a ratio of the nearest; there, inner products in double
precision rank what it meets. How many lists and what ratio that takes is measured: some queries are compared with every vector, and
the lists in which their true neighbours lie tell how far all queries must read.

Largest inner product becomes smallest distance by one more coordinate that brings all vectors to one length. Equal vectors are
one entry with the ``k + 1`` smallest ids: ties go to the smaller id, so no other copy can be among ``k`` results. A list that is
longer than ``longest`` is split by a hash of the vector, and its queries go to every part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

_BLOCK = 512


@dataclass
class Index:
    centroids: np.ndarray  # K x (d + 1), float32
    graph: np.ndarray  # K x degree, the nearest other centroids
    entries: np.ndarray  # where walks begin
    longest_norm: float

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest_norm ** 2 - (x.astype(np.float64) ** 2).sum(axis=1), 0))
        return np.concatenate((x, rest[:, None]), axis=1).astype(np.float32)

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each lifted vector ``width`` centroids, nearest first, and their distances: a best-first walk with a beam of that
        width, for a block of vectors at a time."""
        k = len(self.centroids)
        width = min(width, k)
        if width * self.graph.shape[1] >= k:  # a walk would measure as many distances
            return self._all(x, width)
        ids, dist = np.empty((len(x), width), dtype=np.int64), np.empty((len(x), width), dtype=np.float32)
        for s in range(0, len(x), _BLOCK):
            ids[s:s + _BLOCK], dist[s:s + _BLOCK] = self._walk(x[s:s + _BLOCK], width)
        return ids, dist

    def _all(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` by the distances of all centroids."""
        ids, dist = np.empty((len(x), width), dtype=np.int64), np.empty((len(x), width), dtype=np.float32)
        c = self.centroids.astype(np.float64)
        norms = (c ** 2).sum(axis=1)
        for s in range(0, len(x), _BLOCK):
            y = x[s:s + _BLOCK].astype(np.float64)
            far = np.maximum(norms[None] - 2 * y @ c.T + (y ** 2).sum(axis=1)[:, None], 0)
            at = np.argpartition(far, width - 1, axis=1)[:, :width]
            at = np.take_along_axis(at, np.argsort(np.take_along_axis(far, at, 1), axis=1, kind="stable"), 1)
            ids[s:s + _BLOCK], dist[s:s + _BLOCK] = at, np.sqrt(np.take_along_axis(far, at, 1))
        return ids, dist

    def _far(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = self.centroids[c] - x[:, None, :]
        return np.einsum("bnd,bnd->bn", d, d)

    def _walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, row = len(x), np.arange(len(x))[:, None]
        seen = np.zeros((n, len(self.centroids)), dtype=bool)
        ids = np.tile(self.entries, (n, 1))
        seen[row, ids] = True
        dist = self._far(x, ids)
        if ids.shape[1] < width:
            more = width - ids.shape[1]
            ids, dist = np.pad(ids, ((0, 0), (0, more))), np.pad(dist, ((0, 0), (0, more)), constant_values=np.inf)
        done = ~np.isfinite(dist)
        while True:
            by = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = ids[row, by], dist[row, by], done[row, by]
            step = np.argmin(done, axis=1)
            live = ~done[row[:, 0], step]
            if not live.any():
                return ids, np.sqrt(dist)
            done[row[:, 0], step] = True
            near = self.graph[ids[row[:, 0], step]]
            fresh = ~seen[row, near] & live[:, None]
            seen[row, near] |= live[:, None]
            far = np.where(fresh, self._far(x, near), np.inf)
            ids, dist, done = np.concatenate((ids, near), axis=1), np.concatenate((dist, far), axis=1), np.concatenate((done, ~fresh), axis=1)


def halve(x: np.ndarray, rows: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The rows in parts of at most ``most``, of equal sizes within one at every cut."""
    todo, out = [rows], []
    while todo:
        mine = todo.pop()
        if len(mine) <= most:
            out.append(mine)
            continue
        y = x[mine]
        a, b = y[rng.choice(len(mine), 2, replace=False)]
        for _ in range(6):
            side = np.argsort(y @ (b - a), kind="stable")
            half = len(mine) // 2
            a, b = y[side[:half]].mean(axis=0), y[side[half:]].mean(axis=0)
        todo += [mine[side[:half]], mine[side[half:]]]
    return out


def build(sample: np.ndarray, longest_norm: float, lists: int, degree: int = 24, entries: int = 8, seed: int = 5) -> Index:
    rng = np.random.default_rng(seed)
    index = Index(np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), longest_norm)
    x = index.lift(sample, False)
    parts = halve(x, np.arange(len(x)), max(1, -(-len(x) // lists)), rng)
    index.centroids = c = np.array([x[p].mean(axis=0) for p in parts], dtype=np.float32)
    degree = min(degree, len(c) - 1)
    norms, graph = (c ** 2).sum(axis=1), np.zeros((len(c), max(degree, 1)), dtype=np.int64)
    for s in range(0, len(c), 1024):
        far = norms[None, :] - 2 * c[s:s + 1024] @ c.T
        far[np.arange(len(far)), np.arange(s, s + len(far))] = np.inf
        if degree:
            graph[s:s + 1024] = np.argpartition(far, degree - 1, axis=1)[:, :degree]
    # a ring through all of them, so that every centroid can be reached
    order = rng.permutation(len(c))
    ring = order[(np.argsort(order) + 1) % len(c)]
    ring = np.where((graph == ring[:, None]).any(axis=1), np.arange(len(c)), ring)  # a row names no centroid twice
    graph = np.concatenate((graph, ring[:, None]), axis=1)
    index.graph, index.entries = graph, np.sort(rng.choice(len(c), min(entries, len(c)), replace=False))
    return index


def lists_of(index: Index, x: np.ndarray, copies: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each vector: the nearest, and up to ``copies - 1`` more within ``1 + slack`` of its distance, as (row of the
    vector, list)."""
    ids, dist = index.nearest(index.lift(x, False), 4 * copies)
    ids, dist = ids[:, :copies], dist[:, :copies]
    row, at = np.nonzero(dist <= (1 + slack) * dist[:, :1])
    return row, ids[row, at]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _assign(pickled: bytes, copies: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(pickled)
        for b in batches:
            if b.num_rows:
                row, to = lists_of(index, _matrix(b.column(1)).astype(np.float32), copies, slack)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)], names=["list", "key", "v", "ids"])
    return run


def _ask(pickled: bytes, probes: int, least: int, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(pickled)
        for b in batches:
            if b.num_rows:
                ids, dist = index.nearest(index.lift(_matrix(b.column(1)).astype(np.float32), True), probes)
                use = (dist <= ratio * dist[:, :1]) | (np.arange(ids.shape[1]) < least)
                at = pa.array(np.repeat(np.arange(b.num_rows), use.sum(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[use]), b.column(0).take(at), b.column(1).take(at)], names=["list", "key", "v"])
    return run


def _score(k: int):
    """The best ``k`` (id, inner product) that each query of a list part meets there."""
    def run(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or held.empty:
            return pd.DataFrame({"key": pd.Series([], dtype="int64"), "found": pd.Series([], dtype=object)})
        q, c = (np.array(x["v"].tolist(), dtype=np.float64) for x in (queries, held))
        sizes = held["ids"].map(len).to_numpy()
        out = []
        for s in range(0, len(q), 256):
            rough = q[s:s + 256] @ c.T
            take = min(len(c), k + 8)
            best = np.argpartition(-rough, take - 1, axis=1)[:, :take]
            for i, cols in enumerate(best):
                exact = (c[cols] * q[s + i]).sum(axis=1)
                ids = np.concatenate([held["ids"].iat[j] for j in cols])
                score = np.repeat(exact, sizes[cols])
                by = np.lexsort((ids, -score))[:k]
                out.append([(float(score[j]), -int(ids[j])) for j in by])
        return pd.DataFrame({"key": queries["key"].to_numpy(), "found": [[{"score": a, "less": b} for a, b in row] for row in out]})
    return run


def _compare(asked: np.ndarray, k: int):
    """The best ``k`` of a task's vectors for each of the few queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = np.full((len(asked), 0), 0.0), np.zeros((len(asked), 0, asked.shape[1]))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1)).astype(np.float64)
                score = asked @ x.T
                at = np.argpartition(-score, min(k, len(x)) - 1, axis=1)[:, :k]
                best, held = np.concatenate((best, np.take_along_axis(score, at, 1)), axis=1), np.concatenate((held, x[at]), axis=1)
                by = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, held = np.take_along_axis(best, by, 1), np.take_along_axis(held, by[:, :, None], 1)
        if best.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), best.shape[1])), pa.array(best.ravel()), pa.array(list(held.reshape(-1, asked.shape[1])), pa.list_(pa.float64()))], names=["q", "score", "v"])
    return run


def reach(index: Index, entries: DataFrame, asked: np.ndarray, k: int, copies: int, slack: float, recall: float) -> tuple[int, float]:
    """How many lists, and up to which ratio of the nearest one's distance, the queries ``asked`` must read to meet a share of
    ``recall`` of their ``k`` nearest entries."""
    met = entries.mapInArrow(_compare(asked, k), "q long, score double, v array<double>")
    best = met.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "v")), asc=False), 1, k).alias("best")).select("q", F.explode("best.v").alias("v")).collect()
    row, lists = lists_of(index, np.array([r.v for r in best]).astype(np.float32), copies, slack)
    ids, dist = index._all(index.lift(asked.astype(np.float32), True), len(index.centroids))
    place = np.empty_like(ids)
    np.put_along_axis(place, ids, np.broadcast_to(np.arange(ids.shape[1]), ids.shape), 1)
    of = np.array([r.q for r in best])
    first = np.full(len(best), ids.shape[1] - 1)
    np.minimum.at(first, row, place[of[row], lists])
    far = dist[of, first] / np.maximum(dist[of, 0], 1e-9)
    # lists are read in order of distance and both limits must hold: each may lose half
    at = (1 + recall) / 2
    return int(np.quantile(first, at, method="higher")) + 1, float(np.quantile(far, at, method="higher"))


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector of the table's most frequent length that is not zero and has only finite
    components."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null").filter(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (size[0].d if size else -1))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, list_rows: int = 128, sample_rows: int = 65_536, most_lists: int = 16_384, copies: int = 4,
                       slack: float = 0.15, probes: int = 96, least_probes: int = 12, ratio: float = 1.25, longest: int = 4_096, recall: float = 0.95, measured: int = 128, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query the ``k`` rows of ``vectors`` of largest inner product found, without the row of the query's own id: ``query_id,
    rank`` (from 1), ``vec_id, score`` (double precision). Ties go to the smaller id; fewer candidates are all returned.

    The centroids come from about ``sample_rows`` rows chosen by a hash of the id, with lists of ``list_rows`` rows, at most
    ``most_lists`` of them; every row is indexed. ``probes`` lists are read within ``ratio`` of the nearest one's distance, or as many
    and as far as ``measured`` of the queries, compared with every row, need for ``recall``, if that is more. Rows and queries with a null id or a vector that is null, zero, of another length
    than most, or with a null or non-finite component take no part. Rows that repeat an id and its vector are one; an id with
    several vectors stands for each. Other columns are ignored. No rows give no rows."""
    spark = vectors.sparkSession
    rows = stage(valid_vectors(vectors, id_col, vector_col).distinct())
    asked = rows if queries is None else valid_vectors(queries, id_col, vector_col).distinct()
    told = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not told.n:
        return spark.createDataFrame([], empty)
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = np.array([r.v for r in rows.filter(drawn < sample_rows / told.n).orderBy("vec_id").select("v").toLocalIterator()] or [rows.first().v])
    index = build(sample, float(np.sqrt(told.m)), int(min(most_lists, max(1, len(sample) // 4), -(-told.n // list_rows))))
    pickled = pickle.dumps(index)

    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = (rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
               .select(F.xxhash64("v").alias("key"), "v", "ids"))
    held = stage(entries.mapInArrow(_assign(pickled, copies, slack), "list long, key long, v array<double>, ids array<long>"))
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / longest).cast("long").alias("parts"))
    held = held.join(sizes, "list").withColumn("part", F.pmod("key", "parts"))
    keyed = stage(asked.select(F.col("vec_id").alias("query_id"), "v"))
    points = keyed.groupBy("v").agg(F.min("query_id").alias("key")).select("key", "v")
    if probes < len(index.centroids):
        few = points.orderBy(F.xxhash64("key", F.lit(7)), "key").limit(measured).collect()
        if few:
            need, far = reach(index, entries, np.array([r.v for r in few]), k + 1, copies, slack, recall)
            probes, ratio = max(probes, need), max(ratio, far * (1 + 1e-5))
    probing = points.mapInArrow(_ask(pickled, probes, least_probes, ratio), "list long, key long, v array<double>")
    probing = probing.join(sizes, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = (probing.select("list", "part", "key", "v").groupBy("list", "part").cogroup(held.select("list", "part", "v", "ids").groupBy("list", "part"))
           .applyInPandas(_score(k + 1), "key long, found array<struct<score: double, less: long>>"))
    # a vector is in at most ``copies`` lists, each of which gives it the same score
    best = met.groupBy("key").agg(F.slice(F.array_distinct(F.slice(F.sort_array(F.flatten(F.collect_list("found")), asc=False), 1, (k + 1) * copies)), 1, k + 1).alias("found"))
    named = keyed.join(points.select("v", "key"), "v").select("query_id", "key").join(best, "key")
    own = F.filter("found", lambda x: -x["less"] != F.col("query_id"))
    return named.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), (-F.col("x.less")).alias("vec_id"), F.col("x.score").alias("score"))
