"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of the fingerprints are grouped into parts so that correlated bits stand together. A pair within ``distance`` differing
bits must, for thresholds that add up to ``distance - parts + 1``, be within the threshold of at least one part (-1: the part is
not probed). Dynamic programming picks the thresholds of the smallest estimated number of probes and candidates, each part's
collisions being counted over all distinct fingerprints. A fingerprint is sent to the key of its bits in a part, and at a threshold
of one also to the keys with one bit flipped; fingerprints that meet are verified on all 64 bits.

A key that holds more than ``crowd`` fingerprints is not compared pair by pair. Its fingerprints go to the balls of radius one
around them instead: two are within two bits exactly when their balls share a point, at most 65 fingerprints share one, and all
that do are linked, so the work stays linear in the fingerprints however many stand close together. (``distance`` is at most 2.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import by_batch, id_and_text, utf8
from .components import components

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
BITS = 64


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words of the text with A-Z lowered, repeats included; of the whole sequence if it is shorter;
    of nothing if it has no word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - size)].tolist()]
    stops = (ends[size - 1:] - 1).tolist() if len(words) >= size else [len(line)]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number of the bits set in over half of the hashes; zero without any."""
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[k:k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, size: int, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; zero if it has no word."""
    return majority(shingle_hashes(text, size, seed))


def _fingerprints(size: int):
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, size) for t in utf8(b.column(1))], pa.int64())], schema=_FP)
    return each


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return id_and_text(docs, id_col, text_col).mapInArrow(by_batch(_fingerprints, size), "doc_id long, fp long")


def _moments():
    """Of each batch of fingerprints, how often each pair of bits is set together: 64 x 64 sums, so as much for any input."""
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both = np.rint(x.T @ x).astype(np.int64).ravel()
        return pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(both), pa.array(np.full(BITS * BITS, b.num_rows))], names=["cell", "both", "n"])
    return each


def bit_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of nearly equal size, each grown from the free bit that leans least towards the others by adding
    the free bit most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, found = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [min(free, key=lambda i: (corr[i, sorted(free)].sum(), i))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            free.remove(best)
        found.append(sorted(group))
    return found


def thresholds(cost: list[list[float]], distance: int) -> list[int]:
    """Per part a threshold from -1 up, adding up to ``distance - parts + 1``, of the least total cost; ``cost[i][t + 1]`` is that
    of threshold t in part i."""
    total = distance - len(cost) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picks) in best.items():
            for k, x in enumerate(row):
                if (t := s + k - 1) not in step or c + x < step[t][0]:
                    step[t] = (c + x, [*picks, k - 1])
        best = step
    return best[total][1]


def _key(bits: list[int]):
    """The bits of a part, the others cleared. Two keys of one part are equal when the part's bits are."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flip(key, bit: int):
    return key.bitwiseXOR(F.lit(-(1 << 63) if bit == 63 else 1 << bit))


def _verify(distance: int):
    """Rows (part, key, fp, own) ordered by part and key. A key's fingerprints are held in blocks of at most ``crowd`` by the anti
    join before. Gives a spanning forest of the links among those that meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            cuts = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            edges = [0, *cuts.tolist()]
            last = edges[-1]
            yield from _links(rows, edges, distance)
            kept = [x[last:] for x in rows]
        if kept is not None:
            yield from _links(kept, [0, len(kept[0])], distance)
    return run


def _links(rows, edges: list[int], distance: int) -> Iterator[pa.RecordBatch]:
    left, right = [], []
    for s, e in zip(edges, edges[1:], strict=False):
        if e - s < 2:
            continue
        fp, own = rows[2][s:e].view(np.uint64), rows[3][s:e]
        group = np.arange(e - s)
        for i in range(e - s - 1):
            near = np.flatnonzero((np.bitwise_count(fp[i + 1:] ^ fp[i]) <= distance) & (own[i + 1:] | own[i])) + i + 1
            for j in near[group[near] != group[i]]:
                if group[j] != group[i]:
                    left.append(rows[2][s + i])
                    right.append(rows[2][s + j])
                    group[group == group[j]] = group[i]
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=_LINK)


def near_links(fps: DataFrame, distance: int = 2, parts: int = 3, crowd: int = 512) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints ``fp``: every two within ``distance`` differing bits are connected by them, and
    no link joins two farther apart."""
    if not 1 <= distance <= 2:
        raise ValueError("distance is 1 or 2")
    spark = fps.sparkSession
    sums = fps.mapInArrow(by_batch(_moments), "cell long, both long, n long").groupBy("cell").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).orderBy("cell").collect()
    if not sums:
        return spark.createDataFrame([], "a long, b long")
    n = sums[0].n
    both = np.array([r.both for r in sums], dtype=np.float64).reshape(BITS, BITS)
    groups = bit_parts(both, n, parts)
    exact = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _key(g).alias("key")) for k, g in enumerate(groups)])).alias("x")).select("x.*")
    met = {r.part: r.pairs for r in exact.groupBy("part", "key").count().groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    p = np.diag(both) / n
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-6, 1)
    wider = [1 + float(((1 - agree[g]) / agree[g]).sum()) for g in groups]
    plan = thresholds([[0.0, n + met.get(k, 0), n * (1 + len(g)) + met.get(k, 0) * wider[k]] for k, g in enumerate(groups)], distance)
    sent = []
    for k, (g, t) in enumerate(zip(groups, plan, strict=True)):
        if t >= 0:
            sent.append(F.array(F.struct(F.lit(k).alias("part"), _key(g).alias("key"), F.lit(True).alias("own"))))
        if t == 1:
            sent.append(F.array(*[F.struct(F.lit(k).alias("part"), _flip(_key(g), b).alias("key"), F.lit(False).alias("own")) for b in g]))
    probes = fps.select("fp", F.explode(F.concat(*sent)).alias("x")).select("x.part", "x.key", "fp", "x.own")
    crowded = stage(probes.groupBy("part", "key").count().filter(F.col("count") > crowd).select("part", "key"))
    few = probes.join(crowded, ["part", "key"], "left_anti")
    met_few = (few.repartition("part", "key").sortWithinPartitions("part", "key", "fp").select("part", "key", "fp", "own")
               .mapInArrow(_verify(distance), "a long, b long"))
    if crowded.isEmpty():
        return met_few
    many = probes.join(crowded, ["part", "key"], "left_semi").select("fp").distinct()
    ball = many.select("fp", F.explode(F.array("fp", *[_flip(F.col("fp"), b) for b in range(BITS)])).alias("point"))
    # at a distance of one, a ball's centre is the only point that proves a link
    meet = ball if distance == 2 else ball.withColumn("centre", F.col("fp") == F.col("point"))
    held = meet.groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("fps"), *([F.max(F.when(F.col("centre"), F.col("fp"))).alias("centre")] if distance == 1 else []))
    if distance == 2:
        star = held.filter(F.size("fps") > 1).select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, BITS + 1)).alias("b"))
    else:
        star = held.filter(F.col("centre").isNotNull()).select(F.col("centre").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return met_few.unionByName(star.distinct())


def simhash_groups(docs: DataFrame, size: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, crowd: int = 512) -> DataFrame:
    """One row a document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links of at
    most ``distance`` differing bits. ``size`` words make a shingle; a shorter text is one shingle.

    A null or wordless text has the fingerprint zero and links like any other. A null id is never a ``component_id`` unless the
    component has no other. Equal fingerprints, so repeated rows too, are one point of the search. Other columns are ignored. No
    rows give no rows."""
    prints = stage(fingerprints(docs, size, id_col, text_col))
    points = stage(prints.select("fp").distinct())
    roots = components(near_links(points, distance, parts, crowd))
    labelled = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, F.col("fp") == F.col("node"), "left")
    labelled = stage(labelled.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
