"""Segmentation of a transcript into sentence units.

Recordings are segmented chunk by chunk (``chunk_cuts``, about a minute of speech ending at a sentence), so a group is a few
hundred words however long the recording is; units that a seam splits are joined afterwards by a walk over units. Inside a
chunk the ordered rules (smoothing, grouping, merging, absorbing) are folds over arrays, written with SQL higher-order
functions and run in the JVM.

``W`` is a chunk's word array: STRUCT<idx, word, s, e, conf, and the word flags>. A group is STRUCT<lab, ix> with ``ix`` the
places of its words in ``W``. Times are milliseconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as wr
from ..functions.scan import following, last_seen, leap, next_seen, prev, row_number, scan
from ..functions.spans import bucket_of, overlap_join
from ..functions.words import LEXICON, Lexicon
from ..session import stage
from .transcript import chunk_cuts, own_words

M = ["media_id"]
CHUNK = 600_000


@dataclass(frozen=True)
class Rules:
    min_len: int = 2_000
    max_len: int = 12_000
    backchannel: int = 600
    long_pause: int = 1_500
    break_pause: int = 1_000
    merge_gap: int = 1_000
    snap: int = 500
    flip_words: int = 3
    flip_max: int = 1_000
    overlap_min: int = 100
    turn_gap: int = 300
    fragment: int = 3
    anchor: int = 300


RULES = Rules()


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``value`` evaluated once under ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def word_flags(words: DataFrame, lex: Lexicon = LEXICON) -> DataFrame:
    """Words with the flags the rules read: ends (a sentence, whatever follows), soft (only before a word that opens one),
    clause, marked, asks, shout, opens, cap, num, bc, filler, answer, dangling, so, pron (the pronoun I)."""
    b = wr.bare("word")
    p = wr.plain("word")
    # A word of ASCII letters alone has no mark, is its own plain form, and its first letter is its first character: one test spares
    # it the patterns of the others.
    bare, low, upper = F.col("__bare"), F.col("__low"), F.rlike("word", F.lit("^[A-Z]"))

    def unmarked(then, other) -> Column:
        return F.when(bare, then).otherwise(other)
    no = F.lit(False)
    x = words.withColumn("__bare", F.rlike("word", F.lit("^[A-Za-z]+\\z")))
    x = x.withColumn("__low", unmarked(F.lower("word"), p))
    return x.withColumns({
        "ends": unmarked(no, wr.sentence_end("word", None, lex)), "soft": unmarked(no, F.rlike(b, F.lit("[.…]$"))), "clause": unmarked(no, wr.clause_end("word")),
        "marked": unmarked(no, wr.marked("word")), "asks": unmarked(no, wr.question("word")), "shout": unmarked(no, F.rlike(b, F.lit("[?!]$"))),
        "opens": unmarked(upper, wr.opens("word")), "cap": unmarked(upper, wr.capital("word")), "num": unmarked(low.isin(*lex.number_words), wr.numeric("word", lex)),
        "bc": low.isin(*lex.backchannels), "filler": low.isin(*lex.fillers), "answer": low.isin(*lex.answers), "dangling": low.isin(*lex.dangling), "so": low == "so",
        "pron": unmarked(low == "i", F.split(F.regexp_replace(p, "’", "'"), "'")[0] == "i")}).drop("__bare", "__low")


FLAGS = ("ends", "soft", "clause", "marked", "asks", "shout", "opens", "cap", "num", "bc", "filler", "answer", "dangling", "so", "pron")


def _send(a: str, b: str) -> str:
    return f"({a}.ends and (not {a}.soft or {b}.opens))"


def _complete(a: str, b: str, r: Rules) -> str:
    return f"({_send(a, b)} or ({b}.s - {a}.e >= {r.turn_gap} and {b}.opens))"


def _bound(a: str, b: str) -> str:
    return f"(not {a}.marked and (({a}.num and {b}.num) or ({a}.cap and {b}.cap)))"


def _long_break(a: str, b: str, r: Rules) -> str:
    return f"({b}.s - {a}.e >= {r.long_pause} and ({_send(a, b)} or ({b}.cap and not {b}.pron and not {a}.dangling)))"


def _crosstalk(spk: str, other: str, a: str, b: str, r: Rules) -> str:
    return (f"exists(O, m -> m.speaker = {spk} and exists(O, o -> o.speaker = {other} and least(m.e, o.e, {b}) - greatest(m.s, o.s, {a}) >= {r.overlap_min}))")


def _labels(r: Rules) -> str:
    """Each word's speaker by the turn at its middle (``T``), ties going to the word before's."""
    def pick(rows: str) -> str:
        return f"if(exists({rows}, x -> x.speaker = p), p, get({rows}, 0).speaker)"
    d = "greatest(2 * x.s - t2, t2 - 2 * x.e)"
    longest = _let("array_max(transform(ins, y -> y.e - y.s))", "mx", _let("filter(ins, x -> x.e - x.s = mx)", "top", pick("top")))
    near = _let(f"array_min(transform(T, x -> {d}))", "dm", _let(f"filter(T, x -> {d} = dm)", "cl", f"struct(dm as d, {pick('cl')} as spk)"))
    near = _let(near, "nr", f"coalesce(if(nr.d <= {2 * r.snap}, nr.spk, null), p, nr.spk, 'S1')")
    # Most words lie in one turn only: the turns are searched once for them.
    one = _let("w.s + w.e", "t2", _let("filter(T, x -> 2 * x.s <= t2 and t2 <= 2 * x.e)", "ins",
                                       f"case when size(ins) = 1 then ins[0].speaker when size(ins) = 0 then {near} else {longest} end"))
    return f"aggregate(W, cast(array() as array<string>), (ls, w) -> concat(ls, array({_let('element_at_last(ls)', 'p', one)})))".replace(
        "element_at_last(ls)", "if(size(ls) > 0, element_at(ls, -1), cast(null as string))")


def _runs(labels: str) -> str:
    """Maximal runs of equal labels as STRUCT<i, j, lab>."""
    return (f"aggregate(sequence(0, size({labels}) - 1), cast(array() as array<struct<i:int,j:int,lab:string>>), (rs, k) -> if(size(rs) > 0 and element_at(rs, -1).lab = {labels}[k], "
            f"concat(slice(rs, 1, size(rs) - 1), array(struct(element_at(rs, -1).i as i, k as j, {labels}[k] as lab))), concat(rs, array(struct(k as i, k as j, {labels}[k] as lab)))))")


def _run_kind(r: Rules) -> str:
    """What the short run ``x`` between words of ``fl`` is: turn, backchannel or flip."""
    a, b = "W[x.i]", "W[x.j]"
    bef, aft = "W[x.i - 1]", "W[x.j + 1]"
    words = "slice(W, x.i + 1, x.j - x.i + 1)"
    talk = _crosstalk("x.lab", "fl", f"{a}.s", f"{b}.e", r)
    return _let(talk, "ct", f"""case when {b}.e - {a}.s <= {r.backchannel} and forall({words}, w -> w.bc) then
        if(not (ct or {bef}.marked or {b}.marked or {a}.s - {bef}.e >= {r.turn_gap} or {aft}.s - {b}.e >= {r.turn_gap}) and not forall({words}, w -> w.filler), 'flip', 'backchannel')
      when ct or ({a}.s - {bef}.e >= {r.long_pause} and {aft}.s - {b}.e >= {r.long_pause}) then 'turn'
      when {bef}.asks and {_complete(b, aft, r)} then 'turn'
      when {b}.asks and {aft}.s - {b}.e >= {r.turn_gap} and {_complete(bef, a, r)} then 'turn' else 'flip' end""")


def _short_runs(runs: str, kind: str, r: Rules) -> str:
    """Short runs between two runs of one other speaker that are of ``kind``, with their rank for relabelling."""
    cond = (f"{runs}[k - 1].lab = {runs}[k + 1].lab and ({runs}[k].j - {runs}[k].i + 1 <= {r.flip_words} or W[{runs}[k].j].e - W[{runs}[k].i].s < {r.flip_max})")
    row = (f"struct(W[{runs}[k].j].e - W[{runs}[k].i].s as span, {runs}[k].j - {runs}[k].i + 1 as n, -({runs}[k].i - {runs}[k - 1].i + {runs}[k + 1].j - {runs}[k].j) as fl, "
           f"{runs}[k].i as i, {runs}[k].j as j, {runs}[k - 1].lab as lab)")
    test = _let(f"{runs}[k]", "x", _let(f"{runs}[k - 1].lab", "fl", _run_kind(r)))
    return (f"if(size({runs}) < 3, array(), transform(filter(sequence(1, greatest(size({runs}) - 2, 1)), k -> {cond} and {test} = '{kind}'), k -> {row}))")


def _smooth(r: Rules) -> str:
    """Labels with diarization flips relabelled one at a time, shortest first, until none is left; and the words of the short
    runs kept as real turns: STRUCT<l, kept>."""
    flips = _short_runs("rs", "flip", r)
    relabel = "transform(st.l, (x, q) -> if(q between b.i and b.j, b.lab, x))"
    step = _let(_runs("st.l"), "rs", _let(f"array_min({flips})", "b", f"if(b is null, struct(st.l as l, true as done), struct({relabel} as l, false as done))"))
    fold = f"aggregate(sequence(1, size(L)), struct(L as l, false as done), (st, z) -> if(st.done, st, {step})).l"
    kept = _let(_runs("fin"), "rs", _let(_short_runs("rs", "turn", r), "tn", "flatten(transform(tn, x -> sequence(x.i, x.j)))"))
    return _let(fold, "fin", f"struct(fin as l, cast({kept} as array<int>) as kept)")


def _snap(r: Rules) -> str:
    """Labels with a turn change that falls mid-sentence moved to the nearest sentence end at most three words away."""
    fw = r.fragment
    a, b = "W[i - 1]", "W[i]"
    bcs = lambda lo, hi: f"(W[{hi}].e - W[{lo}].s <= {r.backchannel} and forall(slice(W, {lo} + 1, {hi} - {lo} + 1), w -> w.bc))"
    back = (f"get(filter(transform(sequence(i, least(i + {fw} - 1, be)), e -> struct(e + 1 - i as n, 0 as o, i as lo, e as hi, ls[i - 1] as lab)), m -> if(m.hi + 1 < size(W), "
            f"{_send('W[m.hi]', 'W[m.hi + 1]')}, W[m.hi].ends)), 0)")
    forth = (f"get(filter(transform(if(i - 1 > greatest(i - 1 - {fw}, a0), sequence(i - 1, greatest(i - 1 - {fw}, a0) + 1, -1), array()), lo -> struct(i - lo as n, 1 as o, lo as lo, i - 1 as hi, ls[i] as lab)), "
             f"m -> {_send('W[m.lo - 1]', 'W[m.lo]')}), 0)")
    moves = _let(back, "bk", _let(forth, "fo", f"array_min(filter(array(if(be - bk.hi > {fw}, bk, null), if(fo.lo - a0 > {fw}, fo, null)), m -> m is not null))"))
    ends = ("coalesce(array_min(filter(sequence(i, size(ls) - 1), q -> ls[q] <> ls[i])), size(ls)) - 1", "coalesce(array_max(filter(sequence(0, i - 1), q -> ls[q] <> ls[i - 1])), -1) + 1")
    change = _let(ends[0], "be", _let(ends[1], "a0", f"if({bcs('a0', '(i - 1)')} or {bcs('i', 'be')}, ls, "
                  + _let(moves, "mv", "if(mv is null, ls, transform(ls, (x, q) -> if(q between mv.lo and mv.hi, mv.lab, x)))") + ")"))
    skip = (f"ls[i - 1] = ls[i] or {_send(a, b)} or {b}.opens or {b}.s - {a}.e >= {r.turn_gap} or array_contains(S.kept, i - 1) or array_contains(S.kept, i)")
    return f"aggregate(if(size(W) > 1, sequence(1, size(W) - 1), array()), S.l, (ls, i) -> if({skip}, ls, {change}))"


def _cut(r: Rules) -> str:
    """Where to cut the words c..i-1 that word i would push past the limit: the last sentence end, else the last clause mark,
    else the longest pause (to 10 ms, the latest) not inside a name or a number."""
    w, n = "W[q - 1]", "W[q]"
    ok = _let(f"filter(ks, q -> {w}.e - W[st.c].s >= {r.min_len})", "ok0", "if(size(ok0) > 0, ok0, ks)")
    free = _let(f"filter(ok, q -> not {_bound(w, n)})", "fr", "if(size(fr) > 0, fr, ok)")
    pause = f"array_max(transform({free}, q -> struct(({n}.s - {w}.e + 5) div 10 as g, q as q))).q"
    return _let("sequence(st.c + 1, i)", "ks", f"coalesce(array_max(filter(ks, q -> {_send(w, n)})), " + _let(ok, "ok", f"coalesce(array_max(filter(ok, q -> {w}.clause)), {pause})") + ")")


def _group(r: Rules) -> str:
    """Groups of words: a new one on a change of speaker, a long pause after complete speech, or a sentence end once two
    seconds long; one that would pass twelve seconds is cut. The fold keeps only the start places."""
    soft = f"({_long_break('W[i - 1]', 'W[i]', r)} or ({_send('W[i - 1]', 'W[i]')} and W[i - 1].e - W[st.c].s >= {r.min_len}))"
    split = f"if(i > 0 and (B[i] <> B[st.c] or {soft}), struct(concat(st.b, array(i)) as b, i as c), st)"
    trim = (f"aggregate(sequence(1, greatest(i - st0.c, 1)), st0, (st, z) -> if(i > st.c and W[i].e - W[st.c].s > {r.max_len}, "
            + _let(_cut(r), "cq", "struct(concat(st.b, array(cq)) as b, cq as c)") + ", st))")
    step = _let(split, "st0", f"if(i > st0.c and W[i].e - W[st0.c].s > {r.max_len}, {trim}, st0)")
    starts = f"aggregate(sequence(0, size(W) - 1), struct(array(0) as b, 0 as c), (st, i) -> {step}).b"
    return _let(starts, "bs", "transform(bs, (x, k) -> struct(B[x] as lab, sequence(x, coalesce(get(bs, k + 1), size(W)) - 1) as ix))")


def _first(g: str) -> str:
    return f"W[{g}.ix[0]]"


def _last(g: str) -> str:
    return f"W[element_at({g}.ix, -1)]"


EMPTY = "cast(array() as array<struct<lab:string,ix:array<int>>>)"


def _merge(groups: str, r: Rules) -> str:
    """Join same-speaker neighbours: mid-sentence unless a long break parts them; else fragments across a short gap that do not
    end in ? or !."""
    a, b = _last("p"), _first("g")
    able = (f"p.lab = g.lab and {_last('g')}.e - {_first('p')}.s <= {r.max_len} and if(not {_send(a, b)}, not {_long_break(a, b, r)}, {b}.s - {a}.e <= {r.merge_gap} and "
            f"({_last('p')}.e - {_first('p')}.s < {r.min_len} or {_last('g')}.e - {_first('g')}.s < {r.min_len}) and not {a}.shout)")
    joined = "concat(slice(gs, 1, size(gs) - 1), array(struct(p.lab as lab, concat(p.ix, g.ix) as ix)))"
    body = _let("get(gs, size(gs) - 1)", "p", f"if(p is not null and {able}, {joined}, concat(gs, array(g)))")
    return f"aggregate({groups}, {EMPTY}, (gs, g) -> {body})"


def _is_bc(g: str, r: Rules) -> str:
    return f"({_last(g)}.e - {_first(g)}.s <= {r.backchannel} and forall({g}.ix, q -> W[q].bc))"


def _drop(groups: str, r: Rules) -> str:
    """Drop interjected backchannels unless the speaker goes on or they answer a question. ``Q``: whether the text before the
    chunk asks (NULL: unknown)."""
    bef, aft = "get(gz, k - 1)", "get(gz, k + 1)"
    goes_on = f"coalesce({aft}.lab = g.lab and W[{aft}.ix[0]].s - {_last('g')}.e < {r.long_pause}, false)"
    asked = f"if(k > 0, W[element_at({bef}.ix, -1)].asks, if(Q is null, forall(g.ix, q -> W[q].answer), Q))"
    other = f"coalesce(if(k > 0, {bef}, {aft}).lab <> g.lab, true)"
    return _let(groups, "gz", f"filter(gz, (g, k) -> {goes_on} or not (not {asked} and {other} and {_is_bc('g', r)}))".replace("get(gz, k - 1)", "get(gz, greatest(k - 1, 0))"))


def _answers(gs: str, k: str, r: Rules) -> str:
    g = f"get({gs}, {k})"
    b, a = f"get({gs}, {k} - 1)", f"get({gs}, {k} + 1)"
    asked = (f"if({k} > 0, {b}.lab <> {g}.lab and W[element_at({b}.ix, -1)].asks, if(Q is null, forall({g}.ix, q -> W[q].answer), Q))")
    comp = f"if({k} + 1 < size({gs}), {_complete(_last(g), f'W[{a}.ix[0]]', r)}, true)"
    return f"({asked} and {comp})"


def _asks(gs: str, k: str, r: Rules) -> str:
    g = f"get({gs}, {k})"
    b, a = f"get({gs}, {k} - 1)", f"get({gs}, {k} + 1)"
    fresh = f"if({k} > 0, {_complete(f'W[element_at({b}.ix, -1)]', _first(g), r)}, {_first(g)}.opens)"
    return f"({k} + 1 < size({gs}) and coalesce({a}.lab <> {g}.lab and {_last(g)}.asks and W[{a}.ix[0]].s - {_last(g)}.e >= {r.turn_gap} and {fresh}, false))"


def _turn(gs: str, k: str) -> str:
    return f"forall(get({gs}, {k}).ix, q -> array_contains(S.kept, q))"


def _stands(gs: str, k: str, r: Rules) -> str:
    return f"({_turn(gs, k)} or {_answers(gs, k, r)} or {_asks(gs, k, r)})"


def _host(r: Rules) -> str:
    """The neighbour the fragment at ``st.k`` merges into, or NULL (see ``absorb``)."""
    g = "st.gs[st.k]"
    gap = f"if(j < st.k, {_first(g)}.s - {_last('st.gs[j]')}.e, {_first('st.gs[j]')}.s - {_last(g)}.e)"
    near = f"transform(filter(array(st.k - 1, st.k + 1), j -> j >= 0 and j < size(st.gs)), j -> struct(j as j, {gap} as gap))"
    own = f"filter(nr, x -> st.gs[x.j].lab = {g}.lab and x.gap < {r.long_pause})"
    others = f"if(not {_turn('st.gs', 'st.k')} and size(nr) > 0 and forall(nr, x -> x.gap < {r.long_pause}), filter(nr, x -> not {_stands('st.gs', 'x.j', r)}), filter(nr, x -> false))"
    pool = _let(own, "ow", f"if(size(ow) > 0, ow, {others})")
    reads = f"if(x.j < st.k, not {_send(_last('st.gs[x.j]'), _first(g))}, not {_send(_last(g), _first('st.gs[x.j]'))})"
    fits = (f"filter({pool}, x -> greatest({_last(g)}.e, {_last('st.gs[x.j]')}.e) - least({_first(g)}.s, {_first('st.gs[x.j]')}.s) <= {r.max_len})")
    best = f"array_min(transform({fits}, x -> struct(not {reads} as late, x.gap as gap, x.j as j))).j"
    return f"if(size({g}.ix) > {r.fragment} or {_answers('st.gs', 'st.k', r)} or {_asks('st.gs', 'st.k', r)}, cast(null as int), {_let(near, 'nr', best)})"


def _absorb(groups: str, r: Rules) -> str:
    """Merge every fragment that has a host into it, left to right, stepping back after a merge."""
    lo = "least(h, st.k)"
    merged = (f"concat(slice(st.gs, 1, {lo}), array(struct(st.gs[h].lab as lab, concat(st.gs[{lo}].ix, st.gs[{lo} + 1].ix) as ix)), slice(st.gs, {lo} + 3, size(st.gs)))")
    step = _let(_host(r), "h", f"if(h is null, struct(st.gs as gs, st.k + 1 as k), struct({merged} as gs, greatest({lo} - 1, 0) as k))")
    return _let(groups, "ga", f"aggregate(sequence(1, 3 * size(ga) + 3), struct(ga as gs, 0 as k), (st, z) -> if(st.k >= size(st.gs), st, {step}), st -> if(st.k >= size(st.gs), st.gs, raise_error('fragments were not all absorbed')))")


def _rebalance(groups: str, r: Rules) -> str:
    """Cut a pair again whose stub the length limit keeps from its own speaker's neighbour, so both parts are longer than a
    fragment."""
    fw = r.fragment
    a, b = "rs[k]", "rs[k + 1]"
    w, n = "W[ws[c - 1]]", "W[ws[c]]"
    f0, l0 = "W[ws[0]]", "W[element_at(ws, -1)]"
    ks = (f"filter(if(size(ws) - {fw} - 1 >= {fw} + 1, sequence({fw} + 1, size(ws) - {fw} - 1), array()), c -> {w}.e - {f0}.s <= {r.max_len} and {l0}.e - {n}.s <= {r.max_len})")
    ok = _let(f"filter(ks, c -> {w}.e - {f0}.s >= {r.min_len} and {l0}.e - {n}.s >= {r.min_len})", "k0", "if(size(k0) > 0, k0, ks)")
    free = _let(f"filter(ok, c -> not {_bound(w, n)})", "fr", "if(size(fr) > 0, fr, ok)")
    other = _let(ok, "ok", f"coalesce(array_max(filter(ok, c -> {w}.clause)), array_max(transform({free}, c -> struct(({n}.s - {w}.e + 5) div 10 as g, c as c))).c)")
    whole = _send(_last(a), _first(b))
    cut = _let(ks, "ks", f"coalesce(array_max(filter(ks, c -> {_send(w, n)})), if({whole} or size(ks) = 0, cast(null as int), {other}))")
    apart = (f"{a}.lab = {b}.lab and {_first(b)}.s - {_last(a)}.e < {r.long_pause} and {_last(b)}.e - {_first(a)}.s > {r.max_len} and "
             f"((size({a}.ix) <= {fw} and not {_stands('rs', 'k', r)}) or (size({b}.ix) <= {fw} and not {_stands('rs', '(k + 1)', r)}))")
    put = (f"transform(rs, (x, q) -> case when q = k then struct(x.lab as lab, slice(ws, 1, cc) as ix) when q = k + 1 then struct(x.lab as lab, slice(ws, cc + 1, size(ws)) as ix) else x end)")
    step = f"if({apart}, {_let(f'concat({a}.ix, {b}.ix)', 'ws', _let(cut, 'cc', f'if(cc is null, rs, {put})'))}, rs)"
    return _let(groups, "gr", f"aggregate(if(size(gr) > 1, sequence(0, size(gr) - 2), array()), gr, (rs, k) -> {step})")


def _settle(r: Rules) -> str:
    """Absorb, re-cut and merge until nothing changes."""
    turn = _merge(_rebalance(_absorb("sv.gs", r), r), r)
    step = _let(turn, "nx", "struct(nx as gs, nx = sv.gs as done)")
    return f"aggregate(sequence(1, 2 * size(GR) + 4), struct(GR as gs, false as done), (sv, zz) -> if(sv.done, sv, {step}), sv -> if(sv.done, sv.gs, raise_error('groups did not settle')))"


def _collected(words: DataFrame, turns: DataFrame, chunks: DataFrame, by: list[str], overlaps: DataFrame | None, lex: Lexicon) -> DataFrame:
    """One row per chunk: W (its words), T (exclusive turns clipped to it), O (overlapping turns), Q (whether the word before it
    asks)."""
    own = own_words(words.select(*by, "idx", "word", "start_ms", "end_ms", "conf"), chunks, by)
    f = word_flags(own, lex)
    rows = F.array_sort(F.collect_list(F.struct("idx", "word", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "conf", *FLAGS)))
    g = f.groupBy(*by, "chunk_no").agg(rows.alias("W"))
    span = chunks.select(*by, "chunk_no", F.col("a_ms").alias("start_ms"), F.col("b_ms").alias("end_ms"))

    def turns_of(t: DataFrame, name: str) -> DataFrame:
        j = overlap_join(t.select(*by, "speaker", "start_ms", "end_ms"), span, by)
        x = F.struct(F.greatest("start_ms", "b_start_ms").alias("s"), F.least("end_ms", "b_end_ms").alias("e"), F.col("speaker"))
        return j.groupBy(*by, F.col("b_chunk_no").alias("chunk_no")).agg(F.array_sort(F.collect_list(x)).alias(name))

    x = g.join(turns_of(turns, "T"), [*by, "chunk_no"], "left")
    if overlaps is None:
        x = x.withColumn("O", F.col("T"))
    else:
        x = x.join(turns_of(overlaps, "O"), [*by, "chunk_no"], "left")
    # Whether the word before the chunk asks; before the first of all there is nothing to answer.
    q = scan(f.groupBy(*by, "chunk_no").agg(F.max_by("asks", "idx").alias("__a")), by, ["chunk_no"], F.expr("chunk_no div 4096"), Q=prev("__a"))
    x = x.join(q.select(*by, "chunk_no", "Q"), [*by, "chunk_no"])
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint,speaker:string>>)")
    return x.withColumns({"T": F.coalesce("T", none), "O": F.coalesce("O", none), "Q": F.coalesce("Q", F.lit(False))})


def label_chunks(words: DataFrame, turns: DataFrame, chunks: DataFrame, by: list[str] = M, overlaps: DataFrame | None = None, rules: Rules = RULES,
                 lex: Lexicon = LEXICON, smooth: bool = True, snap: bool = True) -> DataFrame:
    """Chunks with L (labels by turn), S (smoothed labels and kept words) and B (labels after snapping turn changes)."""
    x = stage(_collected(words, turns, chunks, by, overlaps, lex))
    x = x.withColumn("L", F.expr(_labels(rules)))
    x = x.withColumn("S", F.expr(_smooth(rules) if smooth else "struct(L as l, cast(array() as array<int>) as kept)"))
    return x.withColumn("B", F.expr(_snap(rules) if snap else "S.l"))


def labelled_words(chunks: DataFrame, by: list[str] = M) -> DataFrame:
    """The words of ``label_chunks`` with their labels: raw, smooth, speaker (final) and kept."""
    row = "transform(W, (w, k) -> struct(w.idx as idx, w.word as word, L[k] as raw, S.l[k] as smooth, B[k] as speaker, array_contains(S.kept, k) as kept))"
    return chunks.select(*by, "chunk_no", F.inline(F.expr(row)))


STEPS = ("group", "merge", "drop", "settle")


def group_chunks(labelled: DataFrame, until: str = "settle", rules: Rules = RULES) -> DataFrame:
    """Chunks with GR (groups) after the steps up to ``until``: group, merge, drop (interjections, then merge again), settle."""
    x = labelled.withColumn("GR", F.expr(_group(rules)))
    if until == "group":
        return x
    x = x.withColumn("GR", F.expr(_merge("GR", rules)))
    if until == "merge":
        return x
    x = x.withColumn("GR", F.expr(_merge(_drop("GR", rules), rules)))
    if until == "drop":
        return x
    return x.withColumn("GR", F.expr(_settle(rules)))


def unit_pauses(words: str = "words", rules: Rules = RULES) -> dict:
    """Columns breaks and anchors of a unit's word array (structs with s, e, ends, clause)."""
    k = f"if(size({words}) > 1, sequence(1, size({words}) - 1), cast(array() as array<int>))"
    gap = f"{words}[k].s - {words}[k - 1].e"
    return {"breaks": F.expr(f"filter({k}, k -> {gap} >= {rules.break_pause})"),
            "anchors": F.expr(f"filter({k}, k -> {gap} >= {rules.anchor} and ({words}[k - 1].ends or {words}[k - 1].clause))")}


def _cut_off(r: Rules) -> str:
    """The group is cut off by the next one, another speaker's: it ends mid-sentence on a word no sentence ends on, or the other
    goes on in lower case at once, or both talk as the turn changes. A backchannel never is."""
    n = "get(GR, k + 1)"
    last, first = _last("g"), f"W[{n}.ix[0]]"
    dangles = f"({last}.dangling or ({last}.so and (size(g.ix) = 1 or W[element_at(g.ix, -2)].marked)))"
    talk = _crosstalk("g.lab", f"{n}.lab", f"{last}.s", f"{first}.e", r)
    return (f"(k + 1 < size(GR) and coalesce({n}.lab <> g.lab and not {last}.ends and not forall(g.ix, q -> W[q].bc) and (({first}.s - {last}.e < {r.long_pause} and {dangles}) or "
            f"({first}.s - {last}.e < {r.turn_gap} and not {first}.opens and not {first}.filler) or {talk}), false))")


def explode_units(grouped: DataFrame, by: list[str] = M, rules: Rules = RULES) -> DataFrame:
    """Units of grouped chunks: (by, chunk_no, speaker, start_ms, end_ms, text, words, breaks, anchors, cut_off)."""
    row = (f"transform(GR, (g, k) -> struct(g.lab as speaker, {_first('g')}.s as start_ms, {_last('g')}.e as end_ms, array_join(transform(g.ix, q -> W[q].word), ' ') as text, "
           f"transform(g.ix, q -> W[q]) as words, {_cut_off(rules)} as cut_off))")
    x = grouped.select(*by, "chunk_no", F.inline(F.expr(row)))
    return x.withColumns(unit_pauses("words", rules))


def join_seams(units: DataFrame, by: list[str] = M, max_ms: int = 20_000, gap_ms: int = 1_000, rules: Rules = RULES) -> DataFrame:
    """Join a unit that ends mid-sentence with its speaker's next unit: at most ``gap_ms`` apart and ``max_ms`` in all. Breaks and
    anchors are shifted and the seam added; ids are given in onset order.

    How far a joined unit starting at each unit would reach is known from the next place that must part and from the length
    limit; the walk picks the starts, by pointer doubling, however many units are joined into one."""
    ended = F.rlike(F.regexp_replace("text", "[\"'”’)]+$", ""), F.lit("[.?!…।]$"))
    # Stored first: a scan reads its rows twice, and to make these is to segment.
    u = scan(stage(units), by, ["start_ms", "end_ms", "text"], bucket_of("start_ms", CHUNK), __n=row_number(), __nx=following(F.struct("speaker", "start_ms")))
    u = u.withColumns({"seq": F.col("__n") - 1, "__part": F.col("__nx").isNull() | (F.col("__nx.speaker") != F.col("speaker")) | ended
                       | (F.col("__nx.start_ms") - F.col("end_ms") > gap_ms)}).drop("__n", "__nx")
    u = stage(u)
    stops = scan(u.select(*by, "seq", "start_ms", F.when(F.col("__part"), F.col("seq")).alias("__p")), by, ["seq"], F.expr("seq div 4096"), __stop=next_seen("__p"))
    ends = u.select(*by, F.col("end_ms").alias("__v"), F.lit(0).alias("__k"), "seq", F.col("seq").alias("__e"))
    asks = u.select(*by, (F.col("start_ms") + max_ms).alias("__v"), F.lit(1).alias("__k"), "seq", F.lit(None).cast("bigint").alias("__e"))
    reach = scan(ends.unionByName(asks), by, ["__v", "__k", "seq"], bucket_of("__v", CHUNK), __far=last_seen("__e")).filter("__k = 1").select(*by, "seq", "__far")
    j = stops.join(reach, [*by, "seq"]).select(*by, "seq", F.greatest(F.lit(1), F.least(F.col("__stop"), F.coalesce("__far", F.col("seq"))) - F.col("seq") + 1).alias("n"))
    heads = leap(j, by, "seq", "n")
    m = heads.select(*by, F.col("seq").alias("id0"), F.explode(F.expr("sequence(seq, seq + n - 1)")).alias("seq")).join(u, [*by, "seq"])
    part = F.struct("seq", "speaker", "start_ms", "end_ms", "text", "words", "breaks", "anchors", "cut_off")
    g = m.groupBy(*by, "id0").agg(F.array_sort(F.collect_list(part)).alias("ps"))
    seam = ("struct(concat(a.words, p.words) as words, concat(a.breaks, if(p.start_ms - element_at(a.words, -1).e >= {b}, array(size(a.words)), array()), transform(p.breaks, k -> k + size(a.words))) as breaks, "
            "concat(a.anchors, if(p.start_ms - element_at(a.words, -1).e >= {c} and (element_at(a.words, -1).ends or element_at(a.words, -1).clause), array(size(a.words)), array()), "
            "transform(p.anchors, k -> k + size(a.words))) as anchors)").format(b=rules.break_pause, c=rules.anchor)
    g = g.withColumn("x", F.expr(f"aggregate(slice(ps, 2, size(ps)), struct(ps[0].words as words, ps[0].breaks as breaks, ps[0].anchors as anchors), (a, p) -> {seam})"))
    out = g.select(*by, "id0", F.expr("ps[0].speaker").alias("speaker"), F.expr("ps[0].start_ms").alias("start_ms"), F.expr("element_at(ps, -1).end_ms").alias("end_ms"),
                   F.expr("array_join(transform(ps, p -> p.text), ' ')").alias("text"), "x.words", "x.breaks", "x.anchors", F.expr("element_at(ps, -1).cut_off").alias("cut_off"))
    ids = scan(out.select(*by, "id0"), by, ["id0"], F.expr("id0 div 4096"), id=row_number())
    return out.join(ids.select(*by, "id0", (F.col("id") - 1).alias("id")), [*by, "id0"]).drop("id0")


def segment(words: DataFrame, turns: DataFrame, by: list[str] = M, overlaps: DataFrame | None = None, chunks: DataFrame | None = None, rules: Rules = RULES,
            lex: Lexicon = LEXICON) -> DataFrame:
    """Sentence units of a library of transcripts. ``words(by, idx, word, start_ms, end_ms, conf)``; ``turns`` exclusive;
    ``overlaps`` the turns with crosstalk kept (``turns`` by default)."""
    if chunks is None:
        chunks = chunk_cuts(words, by, lex=lex)
    g = group_chunks(label_chunks(words, turns, chunks, by, overlaps, rules, lex), rules=rules)
    return join_seams(explode_units(g, by, rules), by, rules=rules)


def speech_time(units: DataFrame, turns: DataFrame, by: list[str] = M) -> DataFrame:
    """Units with ``speech_ms``: the speaker's own turns inside, or the words' durations when those say more, within the span; the
    span when neither says anything. ``units(…, id, speaker, start_ms, end_ms, words_ms)``."""
    k = [*by, "id"]
    t = (overlap_join(units.select(*k, "speaker", "start_ms", "end_ms"), turns.select(*by, "speaker", "start_ms", "end_ms"), [*by, "speaker"])
         .groupBy(*k).agg(F.sum("overlap_ms").alias("__t")))
    span = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    v = F.least(F.greatest(F.coalesce("__t", F.lit(0)), F.col("words_ms")), span)
    return units.join(t, k, "left").withColumn("speech_ms", F.when(v > 0, v).otherwise(span)).drop("__t")


def speech_spans(units: DataFrame, turns: DataFrame, by: list[str] = M) -> DataFrame:
    """Speech spans of each unit, one row each: its speaker's turns clipped to it, else its span: (by, id, start_ms, end_ms)."""
    k = [*by, "id"]
    u = units.select(*k, "speaker", "start_ms", "end_ms")
    j = overlap_join(u, turns.select(*by, "speaker", "start_ms", "end_ms"), [*by, "speaker"])
    got = j.select(*k, F.greatest("start_ms", "b_start_ms").alias("start_ms"), F.least("end_ms", "b_end_ms").alias("end_ms"))
    bare = u.join(got.select(*k).distinct(), k, "left_anti").select(*k, "start_ms", "end_ms")
    return got.unionByName(bare)
