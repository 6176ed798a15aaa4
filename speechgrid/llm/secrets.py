"""Secret scans: fixed patterns, and strings that zstandard cannot compress with a dictionary of what stands around them.

The patterns give the base spans. Beyond them, a candidate is a long run of token characters with letters and digits, shortly
after a word such as ``key`` or ``credential`` on its line, or on the last line before it that is not blank if no other candidate
stands between; lines of nothing but candidates go on from such a one. The body of a private key block is one candidate. Its novelty is what it adds to the compressed size, in bytes a
character, when the compressor is primed with a dictionary of common identifiers and with the text around the candidate (without
further copies of itself): names and placeholders are found there and cost next to nothing, a random string nearly its own length.
A long random string of few kinds of characters costs less, as zstandard packs its letters; it is held against random strings of
the same length and kinds of characters.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, id_and_text

KINDS = ("assign", "access", "hex", "novel")

#: The base patterns, with the least length of what counts, and the words one of which each match holds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("passw", "secret", "token", "api")

CANDIDATE_ONLY = re.compile(r"[A-Za-z0-9+/_=-]+")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"key|secret|token|passw|passphrase|credential|auth|bearer|private|signature|pwd", re.IGNORECASE | re.ASCII)
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
BREAK = re.compile(r"(?:\\[rn]|\s)+")
#: Kinds of characters, narrowest first, and the share of the cost of random strings from which a string counts as random.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "0123456789ABCDEFabcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567", "0123456789abcdefghijklmnopqrstuvwxyz",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SHARE = 0.9


def alphabet_of(body: str) -> str:
    """The narrowest kind that holds its letters and digits, with the other characters that it has."""
    used = set(body)
    others = used.difference(ALPHABETS[-1])
    return next(a for a in ALPHABETS if used.difference(others) <= set(a)) + "".join(sorted(others))


def default_identifiers() -> str:
    """Names that code is full of: the keywords and built-in names of Python, joined in pairs by the words of settings."""
    settings = "access account api auth bearer client config connection credential database default description development environment example host identifier key \
        password placeholder port private production public secret service session signature test token user value version your".split()
    names = [*keyword.kwlist, *(n for n in dir(builtins) if not n.startswith("_")), *settings, *(f"{a}_{b}" for a in settings for b in settings)]
    return " ".join(names)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    def __init__(self, identifiers: str, window: int, reach: int, least: float):
        import zstandard

        self.zstd, self.names = zstandard, identifiers.encode()
        self.window, self.reach, self.least = window, reach, least
        self.random: dict[tuple[str, int], float] = {}
        self.empty = len(self.compressor(b" ").compress(b""))

    def compressor(self, around: bytes):
        primed = self.zstd.ZstdCompressionDict(self.names + b"\n" + around, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        return self.zstd.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def cost(self, body: str, around: str) -> float:
        return (len(self.compressor(around.encode()).compress(body.encode())) - self.empty) / len(body)

    def marginal(self, text: str, start: int, end: int, body: str | None = None) -> float:
        """Compressed bytes that the span (or ``body``, what counts of it) adds, for each of its characters."""
        around = (text[max(0, start - self.window):start] + "\n" + text[end:end + self.window]).replace(text[start:end], "")
        return self.cost(text[start:end] if body is None else body, around)

    def random_cost(self, alphabet: str, length: int) -> float:
        """The mean cost of three random strings."""
        at = (alphabet, length)
        if at not in self.random:
            if len(self.random) >= 4096:
                self.random.clear()
            rng = random.Random(f"{length} {alphabet}")
            self.random[at] = sum(self.cost("".join(rng.choices(alphabet, k=length)), "") for _ in range(3)) / 3
        return self.random[at]

    def novel(self, text: str, start: int, end: int, body: str | None = None) -> bool:
        cost = self.marginal(text, start, end, body)
        if cost >= self.least:
            return True
        body = text[start:end] if body is None else body
        alphabet = alphabet_of(body)
        # no random string costs less than its entropy
        return cost >= SHARE * math.log2(len(alphabet)) / 8 and cost >= SHARE * self.random_cost(alphabet, len(body))

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """The bodies of private key blocks that have an END line: from the first to the last line without a colon."""
        out = []
        for m in BLOCK.finditer(text) if "PRIVATE KEY" in text else ():
            stop = text.find("-----END", m.end())
            if stop < 0 or "-----BEGIN" in text[m.end():stop]:
                continue
            lines, at = [], m.end()
            for gap in [*BREAK.finditer(text, m.end(), stop), None]:
                end = gap.start() if gap else stop
                if end > at:
                    lines.append((at, end))
                at = gap.end() if gap else stop
            # a header such as "DEK-Info: AES-128-CBC,01AB" ends with its line
            lines = [(s, e) for s, e in lines if ":" not in text[max(text.rfind("\n", 0, s), m.end() - 1) + 1:e] and CANDIDATE_ONLY.fullmatch(text, s, e)]
            body = "".join(text[s:e] for s, e in lines)
            if body and self.novel(text, lines[0][0], lines[-1][1], body):
                out.append((lines[0][0], lines[-1][1]))
        return out

    def named(self, text: str, start: int) -> bool:
        """Whether a sensitive word stands before ``start`` on its line, or on the last line before that is not blank, after the
        candidates of that line."""
        line = text.rfind("\n", 0, start) + 1
        if SENSITIVE.search(text[max(line, start - self.reach):start]):
            return True
        end = line
        while end and text[end - 1].isspace():
            end -= 1
        if not end or CANDIDATE.search(text, line, start):
            return False
        return bool(SENSITIVE.search(CANDIDATE.split(text[max(text.rfind("\n", 0, end) + 1, end - self.reach):end])[-1]))

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        blocks = self.blocks(text)
        out, goes_on = [(s, 3, e) for s, e in blocks], -1
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            body = m[0]
            if any(s < end and start < e for s, e in blocks):
                continue
            # the whole line, and the line before was one that counts
            alone = not text[text.rfind("\n", 0, start) + 1:start].strip() and not text[end:e if (e := text.find("\n", end)) >= 0 else None].strip()
            named = self.named(text, start) or (alone and goes_on >= 0 and not text[goes_on:start].strip())
            goes_on = end if named and alone else -1
            if not named or not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)) or any(s < end and start < e for s, _, e in base):
                continue
            if self.novel(text, start, end):
                out.append((start, 3, end))
        return out


@lru_cache(maxsize=4)
def _novelty(*args) -> Novelty:
    return Novelty(*args)


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def mask(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    """``text`` with every maximal covered stretch replaced."""
    out, done, reach = [], 0, -1
    for s, _, e in spans:
        if s > reach:
            out += [text[done:s], by]
        reach = max(reach, e)
        done = reach
    return "".join([*out, text[done:]])


def _scan(with_text: bool, by: str, *args):
    novelty = _novelty(*args)

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in b.column(1).to_pylist():
            base = base_spans(text)
            spans = sorted([*base, *novelty.spans(text, base)])
            counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), mask(text, spans, by) if with_text and spans else None))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)
    return each


def secret_scan(docs: DataFrame, identifiers: str | None = None, window: int = 2048, reach: int = 80, least: float = 0.75, with_text: bool = False, by: str = "[SECRET]",
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of each kind, the digest of the base spans, all ``spans`` as ``kind:start:end`` (code points, end
    exclusive), and ``masked``, the text with its spans replaced by ``by`` (null without ``with_text``, or where nothing is found).

    ``identifiers`` primes the compressor, with ``window`` characters on both sides of a candidate; a candidate needs a sensitive
    word within ``reach`` characters before it on its line, or at the end of the last line before that is not blank, and ``least``
    compressed bytes a character or what random strings like it cost. A null text is empty and has
    no spans. A null id is kept. Repeated rows each get a row. Other columns are ignored. No rows give no rows."""
    args = (with_text, by, default_identifiers() if identifiers is None else identifiers, window, reach, least)
    return id_and_text(docs, id_col, text_col).mapInArrow(
        by_batch(_scan, *args), "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, masked string")


def _masking(at: int, size_at: int, by: str, *args):
    novelty = _novelty(*args)

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes = b.column(at).to_pylist(), b.column(size_at).to_pylist() if size_at >= 0 else []
        for k, text in enumerate(texts):
            if text:
                base = base_spans(text)
                spans = sorted([*base, *novelty.spans(text, base)])
                if spans:
                    texts[k] = mask(text, spans, by)
                    if size_at >= 0:
                        sizes[k] = len(texts[k])
        columns = list(b.columns)
        columns[at] = pa.array(texts, b.schema.field(at).type)
        if size_at >= 0:
            columns[size_at] = pa.array(sizes, b.schema.field(size_at).type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)
    return each


def masked(docs: DataFrame, identifiers: str | None = None, window: int = 2048, reach: int = 80, least: float = 0.75, by: str = "[SECRET]", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with every span of ``secret_scan`` in the text replaced by ``by`` and, where that changes a text, its
    length in ``size_col`` (if there is such a column) set anew. Null texts stay null."""
    args = (default_identifiers() if identifiers is None else identifiers, window, reach, least)
    return docs.mapInArrow(by_batch(_masking, docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else -1, by, *args), docs.schema)
