"""Exact de-duplication by Patricia-trie owners.

Every normalised text goes to the partition of its length and content hash. There the texts arrive ordered by (length, hash) and
are inserted whole into a compressed radix trie whose keys are that pair followed by all bytes of the text; a terminal node holds
the owner of its text. As the keys arrive in order of their first bytes, a subtree under a (length, hash) pair is complete when
the next pair begins: it is spilled to the output and freed, so a task holds the subtree of one pair, however large its partition.

Copies are merged batch by batch before the shuffle, so a text that a third of all rows share is sent once a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, id_and_text, utf8

_ROW = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary())])
_SENT = pa.schema([("n_bytes", pa.int64()), ("hash", pa.int64()), ("sha", pa.binary()), ("owner", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_OWNER = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class Trie:
    """A compressed radix trie over byte strings. A node is [edge bytes, children by first byte, value]; value is None but at
    the end of an inserted string."""

    def __init__(self):
        self.root = [b"", {}, None]

    def at(self, key: bytes) -> list:
        """The node where ``key`` ends, made if need be."""
        node, done = self.root, 0
        while done < len(key):
            child = node[1].get(key[done])
            if child is None:
                child = node[1][key[done]] = [key[done:], {}, None]
                return child
            edge = child[0]
            if key.startswith(edge, done):
                node, done = child, done + len(edge)
                continue
            shared = _shared(edge, key, done)
            middle = [edge[:shared], {edge[shared]: child}, None]
            child[0] = edge[shared:]
            node[1][key[done]] = middle
            node, done = middle, done + shared
        return node

    def values(self) -> Iterator:
        todo = [self.root]
        while todo:
            node = todo.pop()
            todo.extend(node[1].values())
            if node[2] is not None:
                yield node[2]


def _shared(edge: bytes, key: bytes, start: int) -> int:
    """How many first bytes of ``edge`` are at ``key[start:]`` too, by halving."""
    low, high = 0, min(len(edge), len(key) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(edge[:mid], start):
            low = mid
        else:
            high = mid - 1
    return low


def _better(a: int | None, b: int | None, largest: bool) -> int | None:
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


def _rows():
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(t.lower()).digest() for t in utf8(b.column(1))], pa.binary())], schema=_ROW)
    return each


def _send(largest: bool):
    """One row for each distinct text of a batch."""
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, list] = {}
        for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            t = t.lower()
            mine = seen.get(t)
            if mine is None:
                seen[t] = [i, 1]
            else:
                mine[0] = _better(mine[0], i, largest)
                mine[1] += 1
        sha = [hashlib.sha256(t).digest() for t in seen]
        return pa.RecordBatch.from_arrays([
            pa.array([len(t) for t in seen], pa.int64()), pa.array([int.from_bytes(s[:8], "big", signed=True) for s in sha], pa.int64()), pa.array(sha, pa.binary()),
            pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array(list(seen), pa.binary())], schema=_SENT)
    return each


def _own(largest: bool):
    def emit(trie: Trie, out: list) -> None:
        out.extend(trie.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, pair = Trie(), None
        for b in batches:
            out: list[tuple] = []
            n_bytes, hashes, shas, owners, counts, bodies = (c.to_pylist() for c in b.columns)
            for length, h, sha, owner, n, body in zip(n_bytes, hashes, shas, owners, counts, bodies, strict=True):
                if (length, h) != pair:
                    emit(trie, out)
                    trie, pair = Trie(), (length, h)
                node = trie.at(length.to_bytes(8, "big") + h.to_bytes(8, "big", signed=True) + body)
                node[2] = (sha, owner, n) if node[2] is None else (sha, _better(node[2][1], owner, largest), node[2][2] + n)
            if out:
                yield _owners(out)
        out = []
        emit(trie, out)
        if out:
            yield _owners(out)
    return run


def _owners(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OWNER.types, strict=True)], schema=_OWNER)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal when identical after lower-casing
    A-Z; of equal texts the row with the smallest (``keep='min'``) or largest (``'max'``) id stays.

    A null text is empty, and all empty texts are one group. A null id loses against any other; where a group has only null ids,
    its ``keep_id`` is null and its rows stay. Rows that repeat an id and its text each get a row, and the same decision. Other
    columns are ignored. No rows give no rows."""
    largest = keep == "max"
    source = id_and_text(docs, id_col, text_col)
    rows = source.mapInArrow(by_batch(_rows), "doc_id long, sha binary")
    sent = source.mapInArrow(by_batch(_send, largest), "n_bytes long, hash long, sha binary, owner long, n long, body binary")
    owners = (sent.repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
              .mapInArrow(_own(largest), "sha binary, keep_id long, group_size long"))
    return rows.join(owners, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _digested(at: int):
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        sha = [hashlib.sha256(t.lower()).digest() for t in utf8(b.column(at).fill_null(""))]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.binary())], names=[*b.schema.names, _DIGEST])
    return each


_DIGEST = "exact_dedup digest"


def one_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows, with all their columns, that stay by ``exact_dedup``, each once: of rows that repeat id and text one stays, that
    with the smallest other columns."""
    owners = exact_dedup(docs, id_col, text_col, keep).filter("kept").select(F.col("doc_id").alias("owner id"), F.unhex("text_sha256").alias("owner digest")).distinct()
    rows = docs.mapInArrow(by_batch(_digested, docs.columns.index(text_col)), T.StructType([*docs.schema.fields, T.StructField(_DIGEST, T.BinaryType())]))
    stay = rows.join(owners, (F.col(_DIGEST) == F.col("owner digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("owner id")), "left_semi")
    rest = [c for c in docs.columns if c not in (id_col, text_col)] or [id_col]
    place = F.row_number().over(Window.partitionBy(_DIGEST, id_col).orderBy(*rest))
    return stay.withColumn("exact_dedup place", place).filter(F.col("exact_dedup place") == 1).select(*docs.columns)
