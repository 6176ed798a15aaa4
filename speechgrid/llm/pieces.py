"""Exact merge-type encoding with a piece vocabulary, by backtracking.

Merging the best-ranked adjacent pair until none is left is the definition of this encoding. A sequence of pieces is its result
exactly when every two neighbours would stay apart if their joined text were merged from scratch, so the encoding can be found
left to right: an Aho-Corasick automaton gives the longest piece at every position; a piece is accepted if it may follow the one
before (they are taken apart again, latest merge first, to see whether merging would have crossed between them); else the next
shorter piece is tried, and where none is left the last accepted piece is shortened. A bit per position remembers where nothing
worked, so a position is never tried twice. The piece sequence is unique, so the first found is the answer.

No piece holds a space mark after another character, or a letter beside a sign: there the text is cut beforehand, and each distinct
part is encoded once while it stays in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, id_and_text, tokenizer_path

MARK = "▁"


class Encoder:
    """Of one model file: a vocabulary whose smaller ids merge first, byte pieces for what it lacks, a space mark before the text."""

    def __init__(self, path: str, cached: int = 250_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model is not one of plain merges with byte pieces and a leading space mark")
        ranked = sorted(((-p.score, i, p.piece) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL))
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.texts = {i: t for _, i, t in ranked}
        self.by_text = {t: i for _, i, t in ranked}
        self.rank = {i: (k if len(t) > 1 else -1) for k, (_, i, t) in enumerate(ranked)}
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.live = {i for i, t in self.texts.items() if len(t) == 1}
        for _, i, t in ranked:
            if len(t) > 1:
                for k in range(1, len(t)):
                    a, b = self.by_text.get(t[:k]), self.by_text.get(t[k:])
                    if a in self.live and b in self.live and max(self.rank[a], self.rank[b]) < self.rank[i] and self.apart(a, b):
                        self.split[i], self.pair[a, b] = (a, b), i
                        self.live.add(i)
                        break
        self.longest = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for i in self.live:
            t = self.texts[i]
            self.longest.add_word(t, (len(t), i))
            self.shorter[i] = next((j for k in range(len(t) - 1, 0, -1) if (j := self.by_text.get(t[:k])) in self.live), -1)
        self.longest.make_automaton()
        self.cut = self._cuts()
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.cached = cached
        self.fits: dict[tuple[int, int], bool] = {}

    def _cuts(self) -> re.Pattern:
        """Parts that no piece reaches out of: marks with the run of letters or of signs after them, marks alone, or an unknown
        character. Letters are what no piece joins to a sign; a sign that some piece joins to a letter counts as a letter."""
        known = set("".join(self.texts.values())) - {MARK}
        joined = {t[k:k + 2] for t in self.texts.values() for k in range(len(t) - 1)}
        if any(b == MARK and a != MARK for a, b in joined):
            raise ValueError("a piece holds a space mark after another character")
        letters = {c for c in known if c.isalpha() or c.isdecimal()}
        while more := {c for ab in joined for c in ab if MARK not in ab and (ab[0] in letters) != (ab[1] in letters)} - letters:
            letters |= more
        runs = "|".join(f"[{''.join(map(re.escape, sorted(x)))}]+" for x in (letters, known - letters) if x)
        return re.compile(f"{MARK}*(?:{runs})|{MARK}+|.", re.DOTALL)

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces from scratch ends with just these two. The merges that made them are
        undone, latest first; each time, a merge across the border that ranks before the one undone shows it would not. Of equal
        ranks the left merge goes first, so it only forbids what lies to its left."""
        limit = None  # (rank, whether an equal rank across the border goes first too)
        while True:
            across = self.pair.get((left, right))
            if across is not None and (limit is None or self.rank[across] < limit[0] or (self.rank[across] == limit[0] and limit[1])):
                return False
            a, b = self.split.get(left), self.split.get(right)
            if a is None and b is None:
                return True
            # the later merge is undone first; of equal ranks the right one was the later
            if b is None or (a is not None and self.rank[left] > self.rank[right]):
                limit = (self.rank[left], False)
                left = a[1]
            else:
                limit = (self.rank[right], True)
                right = b[0]

    def _apart(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= self.cached:
                self.fits.clear()
            known = self.fits[left, right] = self.apart(left, right)
        return known

    def merge_free(self, text: str) -> list[int]:
        """The pieces of a text of known characters."""
        n = len(text)
        first: list[int] = [-1] * n
        size = [0] * n
        for end, (length, i) in self.longest.iter(text):
            at = end - length + 1
            if length > size[at]:
                size[at], first[at] = length, i
        if size[0] == n:
            i = first[0]
            if i in self.live:
                return [i]
        failed, texts = bytearray((n >> 3) + 1), self.texts
        out: list[int] = []
        pos, piece = 0, first[0]
        while True:
            end = pos + len(texts[piece])
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self._apart(out[-1], piece)):
                out.append(piece)
                if end == n:
                    return out
                pos, piece = end, first[end]
                continue
            piece = self.shorter[piece]
            while piece < 0:
                # nothing starts at pos: it fails, and the piece before it is shortened
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= len(texts[piece])
                piece = self.shorter[piece]

    def _part(self, part: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number and the decoded text of a part."""
        if part[-1] not in self.by_text:
            ids = [self.bytes[b] for b in part.encode()]
            return ",".join(map(str, ids)), len(ids), part
        ids = self.merge_free(part)
        return ",".join(map(str, ids)), len(ids), part.replace(MARK, " ")

    def encode(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number, and the text that they decode to."""
        if not text:
            return "", 0, ""
        parts = self.cut.findall(MARK + text.replace(" ", MARK))
        cache = self.cache
        try:
            got = [cache[p] for p in parts]
        except KeyError:
            if len(cache) > self.cached:
                cache.clear()
            for p in parts:
                if p not in cache:
                    cache[p] = self._part(p)
            got = [cache[p] for p in parts]
        ids, sizes, decoded = zip(*got, strict=True)
        return ",".join(ids), sum(sizes), "".join(decoded)[1:]

    def ids(self, text: str) -> list[int]:
        joined = self.encode(text)[0]
        return [int(i) for i in joined.split(",")] if joined else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _encode(path: str | None, full: bool):
    enc = encoder(tokenizer_path("piece_bpe_32k.model", path))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in b.column(1).to_pylist():
            ids, n, decoded = enc.encode(text)
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ([int(i) for i in ids.split(",")] if ids else []) if full else None, decoded if full else None))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)
    return each


def piece_encode(docs: DataFrame, model: str | None = None, full: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``n_tokens``, the digests ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``,
    and with ``full`` the ``ids`` and the ``decoded`` text themselves (else null). ``model`` is the vocabulary file, by default the
    installed one.

    A null or empty text has no ids and decodes to the empty text. A null id is kept. Repeated rows each get a row. A space mark in
    a text is a space once decoded. Other columns are ignored. No rows give no rows."""
    return id_and_text(docs, id_col, text_col).mapInArrow(
        by_batch(_encode, model, full), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
