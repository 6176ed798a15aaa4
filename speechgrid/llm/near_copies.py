"""Near copies by word-shingle similarity, for the pipeline: SimHash links and band links, each checked on the whole texts.

The SimHash search finds texts whose fingerprints differ in two bits. A share of 0.8 of common shingles leaves some ten differing
bits, which no pigeonhole over 64 bits can search, so bands of minimum hashes find the rest: texts that agree in a band, or in the
whole fingerprint, are a group, and every two of a group are tried or connected. First one member of each group is tried against the
others, a row a member; that connects groups of copies. Groups that are not one component then are cut by a hash into blocks of some
hundred members, and every two blocks of a group meet as one row in a task of their own: there all members of different components
are compared by hashed bits, which prove most pairs too many shingles apart; only pairs that may be copies leave the task. So the
rows grow with the members and the links, not with the square of a group, and no group is one task. What is left is kept or dropped
by the exact share of common shingles of both whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import by_slices, id_and_text, utf8
from .components import components
from .simhash import majority, near_links, shingle_hashes

_SIGNED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("n", pa.int64()), ("bits", pa.binary())])
_BITS = 2048


@lru_cache(maxsize=4)
def _mixers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int, seed: int = 11) -> list[int]:
    """A 64-bit key for each band: a mix of its ``rows`` minimum hashes."""
    a, b = _mixers(bands * rows, seed)
    least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[k:k + 4096, None] * a + b).min(axis=0))
    mix, add = _mixers(rows, seed + 1)
    return ((least.reshape(bands, rows) ^ (least.reshape(bands, rows) >> np.uint64(29))) * mix + add).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray, bits: int = _BITS) -> bytes:
    """The bits that distinct hashes set: texts differ in at least as many shingles as bits."""
    out = np.zeros(bits, dtype=bool)
    out[(hashes >> np.uint64(20)) % np.uint64(bits)] = True
    return np.packbits(out).tobytes()


def bits_for(shingles: int) -> int:
    """A power of two, at least twelve a shingle: then few differing shingles hide behind others, in texts of any length."""
    return max(_BITS, 1 << (12 * shingles - 1).bit_length()) if shingles else _BITS


def _sign(size: int, bands: int, rows: int):
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        prints, keys, counts, bits = [], [], [], []
        for t in utf8(b.column(1)):
            h = shingle_hashes(t, size)
            prints.append(majority(h))
            h = np.unique(h)
            keys.append(band_keys(h, bands, rows))
            counts.append(len(h))
            bits.append(sketch(h, bits_for(len(h))))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip((prints, keys, counts, bits), _SIGNED.types[1:], strict=True))], schema=_SIGNED)
    return each


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each row of x differs from each row of y (bytes): the wider side is folded to the narrower, which gives the
    narrower sketch of the same hashes."""
    wide = min(x.shape[1], y.shape[1])
    x, y = (np.ascontiguousarray(np.bitwise_or.reduce(z.reshape(len(z), -1, wide), axis=1)).view(np.uint64) for z in (x, y))
    return np.concatenate([np.bitwise_count(x[k:k + 16, None] ^ y[None]).sum(axis=2, dtype=np.int64) for k in range(0, len(x), 16)])


def survivors(one: tuple, two: tuple, least: float) -> list[tuple[int, int]]:
    """Pairs of members (ids, roots, shingle counts, sketches) of different components whose sketches do not prove a share below
    ``least``: of s shingles in both, more than s (1 - least) / (1 + least) differ."""
    out: list[tuple[int, int]] = []
    widths = [np.array([len(b) for b in side[3]]) for side in (one, two)]
    for w in np.unique(widths[0]):
        for v in np.unique(widths[1]):
            i, j = np.flatnonzero(widths[0] == w), np.flatnonzero(widths[1] == v)
            n, m = one[2][i][:, None], two[2][j][None]
            most = (n + m) * (1 - least) / (1 + least) + 1e-6
            may = (one[1][i][:, None] != two[1][j][None]) & (np.abs(n - m) <= most)
            rows, columns = may.any(axis=1), may.any(axis=0)
            if not rows.any():
                continue
            i, j, may, most = i[rows], j[columns], may[rows][:, columns], most[rows][:, columns]
            x, y = (np.frombuffer(b"".join([side[3][k] for k in at]), dtype=np.uint8).reshape(len(at), -1) for side, at in ((one, i), (two, j)))
            a, b = np.nonzero(may & (apart(x, y) <= most))
            out += zip(one[0][i[a]].tolist(), two[0][j[b]].tolist(), strict=True)
    return out


def _met(least: float):
    """Rows of one block or two: the pairs that may be copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blocks in b.column(0):
                sides = []
                for block in blocks.values:
                    c = {f.name: block.values.field(f.name) for f in block.values.type}
                    sides.append((c["doc_id"].to_numpy(), c["root"].to_numpy(), c["n"].to_numpy(), c["bits"].to_pylist()))
                pairs = np.array(survivors(sides[0], sides[-1], least), dtype=np.int64).reshape(-1, 2)
                pairs.sort(axis=1)
                for k in range(0, len(pairs), 65_536):
                    some = np.unique(pairs[k:k + 65_536], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["a", "b"])
    return run


@lru_cache(maxsize=64)
def _short(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _shingles(text: bytes, size: int) -> np.ndarray:
    return _short(text, size) if len(text) < 100_000 else np.unique(shingle_hashes(text, size))


def similarity(a: bytes, b: bytes, size: int) -> float:
    """The share of common shingles among all of both; 1 for two texts without words."""
    x, y = _shingles(a, size), _shingles(b, size)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _alike(size: int, least: float):
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = [similarity(x, y, size) >= least for x, y in zip(utf8(b.column(2)), utf8(b.column(3)), strict=True)]
        return b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return each


def _checked(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs ``a, b`` that share at least ``least`` of their shingles."""
    one, two = (texts.select(F.col("doc_id").alias(e), F.col("text").alias(f"text_{e}")) for e in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(by_slices(_alike, size, least), "a long, b long").distinct()


def near_copies(docs: DataFrame, size: int = 5, least: float = 0.8, bands: int = 20, rows: int = 5, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every document that shares at least ``least`` of its ``size``-word shingles with another, and of
    those linked to it: the smallest id reachable. Documents without a link are not listed.

    A null text is empty; texts without words are alike. Rows with a null id take no part. Rows that repeat an id are one document,
    with the links of all its texts. Other columns are ignored. No rows give no rows."""
    source = id_and_text(docs, id_col, text_col).filter("doc_id is not null")
    signed = stage(source.mapInArrow(by_slices(_sign, size, bands, rows), "doc_id long, fp long, bands array<long>, n long, bits binary"))
    owners = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("owner")))
    links = near_links(owners.select("fp"))
    by_bits = (links.join(owners.select(F.col("fp").alias("a"), F.col("owner").alias("x")), "a").join(owners.select(F.col("fp").alias("b"), F.col("owner").alias("y")), "b").select("x", "y"))
    group, sketches, texts = ["band", "key"], signed.select("doc_id", "n", "bits"), source.select("doc_id", "text")
    keys = signed.select("doc_id", F.posexplode(F.concat("bands", F.array("fp"))).alias("band", "key"))
    # One member of each group against the others.
    many = keys.groupBy(*group).agg(F.max_by("doc_id", F.struct(F.xxhash64("doc_id", "band"), "doc_id")).alias("centre"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    pairs = keys.join(many.filter("low < high").select(*group, "centre"), group).select(F.col("centre").alias("x"), F.col("doc_id").alias("y")).unionByName(by_bits)
    tried = stage(pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    alike = stage(_checked(tried, texts, size, least))
    roots = stage(components(alike).select(F.col("node").alias("doc_id"), "root"))
    # Blocks of the groups that are not one component: every two of them meet once.
    left = keys.join(roots, "doc_id", "left").select("doc_id", *group, F.coalesce("root", "doc_id").alias("root"))
    apart_ = left.groupBy(*group).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).filter("low < high")
    members = stage(left.join(apart_.select(*group, F.ceil(F.col("members") / block).alias("blocks")), group).distinct())
    held = sketches.join(members.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    slots = (members.join(held, "doc_id").withColumn("slot", F.pmod(F.xxhash64("doc_id", "n", "bits"), F.col("blocks")))
             .groupBy(*group, "slot", "blocks").agg(F.collect_list(F.struct("doc_id", "root", "n", "bits")).alias("block")))
    meet = slots.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).groupBy(
        *group, F.least("slot", "other").alias("lower"), F.greatest("slot", "other").alias("upper")).agg(F.collect_list("block").alias("blocks"))
    may = meet.filter("size(blocks) = 2 OR lower = upper").select("blocks").mapInArrow(_met(least), "a long, b long").distinct()
    more = stage(_checked(stage(may.join(tried, ["a", "b"], "left_anti")), texts, size, least))
    return components(alike.unionByName(more)).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
