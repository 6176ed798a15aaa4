"""Shortest-pack-first packing over the histogram of lengths.

Each document is tokenised once, where it lies, and cut at multiples of the sequence length; the pieces (numbers only, no ids) are
stored. What the packing decides depends on their lengths alone: from the histogram of lengths, of at most as many rows as a
sequence is long, lengths are placed longest first, always into the packs that hold least. Packs of one history are counted, not
listed: a pattern is a range of sequence numbers, and placing ``n`` pieces of a length splits ranges, so the plan stays small
whatever the corpus.

The plan comes back to the documents by rank. A piece's rank among those of its length is its place within its stored part plus
the number of such pieces in the parts before; no group is ordered, however many pieces share a length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import id_and_text, tokenizer_path

#: What the quick way can part exactly as the tokenizer does: plain ASCII and the letters of the Latin-1 and Extended-A blocks,
#: without the one that lower-cases to two characters; no control characters that only some call white space.
ODD = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ſ]")
_LETTER = "a-zß-öø-ſ"
#: How the vocabulary's own pattern parts lower-case text.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")


class Kept(dict):
    """A cache of two bounded generations: what is met again moves to the younger one, and a full younger one takes the elder's
    place. ``make`` gives what neither holds."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        value = self[key] = self.old.get(key) or self.make(key)
        return value


class Tokens:
    """Ids of the word-end vocabulary, as little-endian unsigned 32-bit bytes. No id spans white space, so each distinct string
    between it is encoded once while it stays in a bounded cache, and so is each word in it, by the library's model; texts that the
    quick way cannot part exactly are encoded whole by the library."""

    def __init__(self, path: str, cached: int = 200_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        # the vocabulary writes bytes as characters: the printable ones as themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = dict(zip(plain, plain)) | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.words = Kept(self._word, cached // 2)
        self.parts = Kept(lambda part: b"".join([self.words[w] for w in WORD.findall(part)]), cached)

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes)
        return np.array([t.id for t in self.model.tokenize(word)], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text or ODD.search(text):
            return self._whole(text)
        return b"".join(map(self.parts.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("place", pa.int64())])


def _cut(path: str | None, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens(tokenizer_path("word_bpe_49k.json", path))
        part, end, seen = TaskContext.get().partitionId(), end_id.to_bytes(4, "little"), np.zeros(size + 1, dtype=np.int64).tolist()
        for b in batches:
            rows = []
            for doc, text in ((d, t) for k in range(0, b.num_rows, 512) for d, t in zip(b.column(0).slice(k, 512).to_pylist(), b.column(1).slice(k, 512).to_pylist(), strict=True)):
                ids = memoryview(enc.encode(text) + end)
                n = len(ids) // 4
                for s in range(0, n, size):
                    length = min(size, n - s)
                    rows.append((doc, s, length, zlib.crc32(ids[4 * s:4 * (s + length)]), n, part, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE.types, strict=True)], schema=_PIECE)
    return run


def plan_packs(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, pieces, first sequence, offset)``: the pieces of a length with ranks from the first on go, one each,
    to the sequences from the first on, at that offset. Ranks and sequences count from 0."""
    packs: list[tuple[int, int, int]] = []  # tokens held, first sequence, sequences
    out, fresh = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if packs and packs[0][0] + length <= size:
                held, first, many = heappop(packs)
                take = min(left, many)
                if take < many:
                    heappush(packs, (held, first + take, many - take))
            else:
                held, first, take = 0, fresh, left
                fresh += left
            out.append((length, rank, take, first, held))
            if held + length < size:
                heappush(packs, (held + length, first, take))
            rank, left = rank + take, left - take
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(plan: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.searchsorted(table[:, 0], np.arange(table[:, 0].max(initial=0) + 2))
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (2, 5))
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                mine, (lo, hi) = length == n, base[n:n + 2]
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], schema=_OUT)
    return run


def pack(docs: DataFrame, size: int = 4096, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of a document: ``doc_id, start`` (ids before it), ``length``, ``ids_crc32`` (of its ids as little-endian
    unsigned 32-bit numbers), ``doc_tokens`` (with the end id that closes every document), ``sequence_id`` and ``offset`` (its place
    there). Every id is in one piece; a sequence holds at most ``size`` ids without gaps between its pieces.

    A null or empty text is the end id alone. A null id is kept. Repeated rows are packed each. Other columns are ignored. No rows
    give no rows."""
    pieces = stage(id_and_text(docs, id_col, text_col).mapInArrow(
        _cut(tokenizer, end_id, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long"))
    parts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a part and length: it grows with the parts, so it is never sent to all tasks
    ranked = pieces.join(parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).hint("shuffle_hash"), ["part", "length"])
    plan = plan_packs(counts, size)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place")).alias("rank")).mapInArrow(
        _place(plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
