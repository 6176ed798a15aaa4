"""Chat formatting by quotation linking.

Each message is parsed into its own lines and quoted lines by nesting level. Passages (a run of lines of one level, and its lines)
are normalised and hashed. A quoted passage is joined to the latest earlier message of its conversation whose own words hold it;
the message replies to what it quotes at the outermost level. Following replies to their roots gives threads, and conversations
come out as threads in turn order, every message without its quotes.

No conversation or passage is ordered in one task: the latest earlier place is carried by a scan over stretches of turns, and
roots are found by doubling.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import last_seen, scan
from ..session import stage
from .common import by_batch

QUOTED = re.compile(r"\s{0,3}((?:>[ \t]?)+)(.*)", re.DOTALL)
#: Lines that introduce a quote.
INTRODUCES = re.compile(r".*(?:\bwrote|\bschrieb|\ba écrit|\bescribió)\s*:\s*", re.IGNORECASE)

_PASSAGE = pa.struct([("level", pa.int32()), ("hash", pa.binary())])
_PARSED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("levels", pa.int32()), ("passages", pa.list_(_PASSAGE))])


def _digest(text: str) -> bytes | None:
    words = text.lower().split()
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest() if words else None


def parse(text: str) -> tuple[str, list[tuple[int, bytes]]]:
    """The text without quotes and the (level, hash) of its passages; level 0 is its own."""
    lines = []
    for line in text.splitlines():
        m = QUOTED.fullmatch(line)
        lines.append((m[1].count(">"), m[2]) if m else (0, line))
    own = [body for k, (level, body) in enumerate(lines) if not level and not (k + 1 < len(lines) and lines[k + 1][0] and INTRODUCES.fullmatch(body))]
    found, run = {}, []
    for level, body in [*((lv, b) for lv, b in lines if lv or not INTRODUCES.fullmatch(b)), (-1, "")]:
        if run and (level != run[0][0] or not body.strip()):
            for passage in [" ".join(b for _, b in run), *(b for _, b in run)]:
                if h := _digest(passage):
                    found[run[0][0], h] = None
            run = []
        if level >= 0 and body.strip():
            run.append((level, body))
    return "\n".join(own).strip("\n") if len(own) < len(lines) else text, list(found)


def _parse():
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [parse(t) for t in b.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([t for t, _ in rows], pa.string()), pa.array([max((lv for lv, _ in p), default=0) for _, p in rows], pa.int32()),
                                           pa.array([[{"level": lv, "hash": h} for lv, h in p] for _, p in rows], pa.list_(_PASSAGE))], schema=_PARSED)
    return each


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = 4096) -> DataFrame:
    """One row a message: ``conv_id, thread`` (the turn its thread began with), ``turn, role, reply_to`` (the turn of the message it
    quotes, null if none was found), ``depth`` (replies from the thread's root), ``levels`` of quotes, ``n_quoted`` and ``n_linked``
    passages, and ``text`` without quotes. Ordered by (conv_id, thread, turn) it is the conversation in reply order.

    A quoted passage links to the latest earlier turn; of several, the outermost level counts, then the latest turn. A null text is
    empty. Messages with a null conversation or turn link to none and have a null thread if the turn is null. Repeated rows each get
    a row, and rows of one turn count as one message for replies. Other columns are ignored. No rows give no rows."""
    source = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
                             F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parsed = stage(source.mapInArrow(by_batch(_parse), "conv_id long, turn long, role string, text string, levels int, passages array<struct<level: int, hash: binary>>"))
    passages = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.hash").distinct()
    quoted = stage(passages.filter("level > 0"))
    told = parsed.withColumns({"n_quoted": F.size(F.filter("passages", lambda p: p["level"] > 0))}).drop("passages")
    own = passages.filter("level = 0").join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    # at one turn quotes come first, so that no message answers itself
    events = quoted.unionByName(own).withColumn("rank", F.when(F.col("level") > 0, -F.col("level")).otherwise(1))
    seen = scan(events, ["conv_id", "hash"], ["turn", "rank"], F.expr(f"turn div {stretch}"), source=last_seen(F.when(F.col("level") == 0, F.col("turn")), inclusive=False))
    linked = seen.filter("level > 0 and source is not null and source < turn")
    replies = linked.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("source").alias("source")))["source"].alias("reply_to"), F.count("*").alias("n_linked"))
    roots = _roots(stage(replies))
    return told.join(roots, ["conv_id", "turn"], "left").select(
        "conv_id", F.coalesce("root", "turn").alias("thread"), "turn", "role", "reply_to", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), "levels", "n_quoted",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text")


def _roots(replies: DataFrame, most: int = 60) -> DataFrame:
    """Adds ``root`` and ``depth`` by doubling: each round a reply points to where the one it points to points. A reply's source is
    always earlier, so there are no circles, and the rounds grow with the logarithm of the longest chain."""
    now = replies.withColumns({"root": F.col("reply_to"), "depth": F.lit(1).cast("long")})
    for _ in range(most):
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = stage(now.join(up, ["conv_id", "root"], "left"))
        if joined.filter("next is not null").isEmpty():
            return joined.drop("next", "more")
        now = joined.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    raise RuntimeError("reply chains did not end")
