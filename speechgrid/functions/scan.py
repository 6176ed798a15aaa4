"""Ordered scans (lag, lead, running totals, last seen value) that never need a whole recording in one task.

A plain window over ``media_id`` puts every row of a recording in one task. Here each recording is cut into chunks by an
integer column (usually ``start_ms`` divided by a width). The window runs inside a chunk; one summary row per chunk is
reduced with partial aggregation; a second window runs over those summaries only; and the carried value is joined
back on (by, chunk), the partitioning the first window already left the rows in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

CHUNK_MS = 600_000


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column
    inclusive: bool = True


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def prev(v) -> Step:
    """The value of the row before (NULL for the first)."""
    return Step("prev", _c(v))


def following(v) -> Step:
    """The value of the row after (NULL for the last)."""
    return Step("next", _c(v))


def running_sum(v, inclusive: bool = True) -> Step:
    return Step("sum", _c(v), inclusive)


def running_max(v, inclusive: bool = False) -> Step:
    return Step("max", _c(v), inclusive)


def last_seen(v, inclusive: bool = True) -> Step:
    """The latest non-NULL value so far."""
    return Step("last", _c(v), inclusive)


def next_seen(v, inclusive: bool = True) -> Step:
    """The earliest non-NULL value from here on."""
    return Step("ahead", _c(v), inclusive)


def row_number() -> Step:
    """1-based position."""
    return Step("sum", F.lit(1).cast("bigint"), True)


def scan(df: DataFrame, by: list[str], order: list[str], chunk: Column | None = None, **steps: Step) -> DataFrame:
    """Add one column per step. ``order`` must be a total order whose leading part agrees with ``chunk`` (an integer
    column expression that never decreases along it). ``chunk=None`` plans ordinary windows, for groups that are small by
    construction (one line, one call)."""
    U = Window.unboundedPreceding
    two = chunk is not None
    base = df.withColumn("__c", chunk) if two else df
    keys = [*by, "__c"] if two else list(by)
    w = Window.partitionBy(*keys).orderBy(*order)
    # What lies ahead is read in falling order: a frame that ends with the partition is read anew for every row, one that begins
    # with it grows by a row.
    falling = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])

    def frame(s: Step):
        return (falling if s.kind == "ahead" else w).rowsBetween(U, 0 if s.inclusive else -1)

    local = {}
    for name, s in steps.items():
        if s.kind == "prev":
            local[name] = F.lag(s.value).over(w)
        elif s.kind == "next":
            local[name] = F.lead(s.value).over(w)
        elif s.kind == "sum":
            local[name] = F.coalesce(F.sum(s.value).over(frame(s)), F.lit(0))
        elif s.kind == "max":
            local[name] = F.max(s.value).over(frame(s))
        else:
            local[name] = F.last(s.value, ignorenulls=True).over(frame(s))
    if not two:
        return base.withColumns(local)
    rows = base.withColumns({**local, "__first": F.row_number().over(w) == 1,
                             "__last": F.lead(F.lit(1)).over(w).isNull()})
    o = F.struct(*order)
    agg, carry = [], {}
    wc = Window.partitionBy(*by).orderBy("__c")
    before, after = wc.rowsBetween(U, -1), Window.partitionBy(*by).orderBy(F.col("__c").desc()).rowsBetween(U, -1)
    for name, s in steps.items():
        k = f"__a_{name}"
        if s.kind == "prev":
            agg.append(F.max_by(F.struct(s.value.alias("v")), o).alias(k))
            carry[f"__k_{name}"] = F.lag(F.col(k)).over(wc)["v"]
        elif s.kind == "next":
            agg.append(F.min_by(F.struct(s.value.alias("v")), o).alias(k))
            carry[f"__k_{name}"] = F.lead(F.col(k)).over(wc)["v"]
        elif s.kind == "sum":
            agg.append(F.sum(s.value).alias(k))
            carry[f"__k_{name}"] = F.coalesce(F.sum(k).over(before), F.lit(0))
        elif s.kind == "max":
            agg.append(F.max(s.value).alias(k))
            carry[f"__k_{name}"] = F.max(k).over(before)
        elif s.kind == "last":
            agg.append(F.max_by(s.value, F.when(s.value.isNotNull(), o)).alias(k))
            carry[f"__k_{name}"] = F.last(k, ignorenulls=True).over(before)
        else:
            agg.append(F.min_by(s.value, F.when(s.value.isNotNull(), o)).alias(k))
            carry[f"__k_{name}"] = F.last(k, ignorenulls=True).over(after)
    summary = base.groupBy(*keys).agg(*agg).withColumns(carry).select(*keys, *carry)
    out = rows.join(summary, keys, "left")
    done = {}
    for name, s in steps.items():
        mine, c = F.col(name), F.col(f"__k_{name}")
        if s.kind == "prev":
            done[name] = F.when(F.col("__first"), c).otherwise(mine)
        elif s.kind == "next":
            done[name] = F.when(F.col("__last"), c).otherwise(mine)
        elif s.kind == "sum":
            done[name] = mine + c
        elif s.kind == "max":
            done[name] = F.greatest(mine, c)
        else:
            done[name] = F.coalesce(mine, c)
    return out.select(*df.columns, *[v.alias(n) for n, v in done.items()])


def with_neighbours(df: DataFrame, by: list[str], seq: str, size: int = 1024, **cols) -> DataFrame:
    """Add columns taken from rows a fixed number of places away. ``seq`` numbers the rows of each ``by`` without gaps;
    every keyword is ``name=(column, offset)``. Rows are cut into blocks of ``size``; the few rows near a block's ends
    are copied to the next block, so the window never spans a recording."""
    ahead = max([0, *(o for _, o in cols.values())])
    behind = max([0, *(-o for _, o in cols.values())])
    own = F.expr(f"`{seq}` div {size}")
    pos = F.pmod(F.col(seq), F.lit(size))
    blocks = F.filter(F.array(own, F.when(pos < ahead, own - 1), F.when(pos >= size - behind, own + 1)),
                      lambda b: b.isNotNull())
    x = df.withColumns({"__own": own, "__k": F.explode(blocks)})
    w = Window.partitionBy(*by, "__k").orderBy(seq)
    got = {n: (F.lead(c, o) if o > 0 else F.lag(c, -o)).over(w) for n, (c, o) in cols.items()}
    return x.withColumns(got).filter(F.col("__own") == F.col("__k")).drop("__own", "__k")


def walk(df: DataFrame, by: list[str], seq: str, jump: str, longest: int, size: int = 256, fan: int = 1024) -> DataFrame:
    """The rows a pointer walk lands on: it starts at row 0 of each ``by`` and moves ``jump`` rows ahead (1..longest; a
    longer jump raises). Returns (by, seq, jump) of the rows visited.

    Greedy grouping is such a walk, and it is sequential. Each block of ``size`` rows is summarised by where a walk
    entering at each of its first ``longest`` rows leaves it; the summaries compose, block by block, then over groups of
    ``fan`` blocks; so only the block summaries are ordered, never the rows."""
    assert longest <= size
    blocks = stage(df.groupBy(*by, F.expr(f"`{seq}` div {size}").alias("__k"))
                   .agg(F.array_sort(F.collect_list(F.struct(F.expr(f"`{seq}` % {size}").alias("p"), F.col(jump).alias("j"))))
                        .alias("a")).withColumn("__j", F.expr(
                       f"transform(a, x -> if(x.j between 1 and {longest}, cast(x.j as int), raise_error('a jump outside 1 .. {longest}')))")).drop("a"))
    # Where a walk entering at row i leaves (rows into the next block), from the last row back.
    exits = (f"slice(aggregate(reverse(__j), cast(array() as array<int>), (m, j) -> concat(array("
             f"if(j > size(m), j - size(m) - 1, element_at(m, j))), m)), 1, {longest})")
    maps = blocks.select(*by, "__k", F.expr("__k div {0}".format(fan)).alias("__s"), F.expr(exits).alias("__m"))
    follow = "aggregate(ms, cast(e as int), (e, m) -> if(e < size(m.__m), m.__m[e], 0))"
    ordered = "array_sort(collect_list(struct(__k, __m)))"
    supers = stage(maps.groupBy(*by, "__s").agg(F.expr(ordered).alias("ms"))
                   .withColumn("__c", F.expr(f"transform(sequence(0, {longest - 1}), e -> {follow})")))
    # Entries of the groups: one short ordered list per ``by``.
    entry = ("aggregate(ss, struct(cast(array() as array<struct<s:bigint,e:int>>) as o, 0 as e), (t, s) -> "
             "struct(concat(t.o, array(struct(s.__s as s, t.e as e))) as o, s.__c[t.e] as e)).o")
    top = (supers.groupBy(*by).agg(F.expr("array_sort(collect_list(struct(cast(__s as bigint) as __s, __c)))").alias("ss"))
           .select(*by, F.explode(F.expr(entry)).alias("x")).select(*by, F.col("x.s").alias("__s"), F.col("x.e").alias("__e")))
    inner = ("aggregate(ms, struct(cast(array() as array<struct<k:bigint,e:int>>) as o, __e as e), (t, m) -> "
             "struct(concat(t.o, array(struct(cast(m.__k as bigint) as k, t.e as e))) as o, "
             "if(t.e < size(m.__m), m.__m[t.e], 0) as e)).o")
    entries = (supers.join(top, [*by, "__s"]).select(*by, F.explode(F.expr(inner)).alias("x"))
               .select(*by, F.col("x.k").alias("__k"), F.col("x.e").alias("__e")))
    heads = ("aggregate(sequence(0, size(__j) - 1), struct(__e as n, cast(array() as array<int>) as h), (t, i) -> "
             "if(i = t.n, struct(i + __j[i] as n, concat(t.h, array(i)) as h), t)).h")
    got = blocks.join(entries, [*by, "__k"]).withColumn("__h", F.explode(F.expr(heads)))
    return got.select(*by, (F.col("__k") * size + F.col("__h")).cast("bigint").alias(seq),
                      F.expr("__j[__h]").alias(jump))


def leap(df: DataFrame, by: list[str], seq: str, jump: str, size: int = 256) -> DataFrame:
    """The rows a pointer walk lands on, as ``walk``, for jumps of any length (at least 1; a shorter one raises): (by, seq, jump).
    ``seq`` numbers the rows of each ``by`` from 0 without gaps.

    Blocks of ``size`` rows are summarised by where a walk entering at each row leaves the block. Of these exits only those another
    block leads to, and row 0, can be visited: they are a forest, ranked by pointer doubling. A round joins the table of exits with
    itself, so an exit leads twice as many blocks on, and adds where the places reached so far lead; the rounds grow with the
    logarithm of the blocks on the longest walk, and each is a stored table keyed by place. A walk enters a block once, so the
    places reached are the entries, and each block follows its own."""
    at = f"{size}L * __k"
    blocks = stage(df.groupBy(*by, F.expr(f"`{seq}` div {size}").alias("__k")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("p"), F.col(jump).cast("bigint").alias("j")))).alias("a"))
        .withColumn("__j", F.expr("transform(a, x -> if(x.j >= 1, x.j, raise_error('a jump below 1')))")).drop("a"))
    # From the last row back: a jump within the block leads where its target leads.
    leaves = ("aggregate(reverse(__j), cast(array() as array<bigint>), (m, j) -> concat(array("
              f"if(j > size(m), {at} + size(__j) - 1 - size(m) + j, element_at(m, cast(j as int)))), m))")
    exits = blocks.select(*by, "__k", F.posexplode(F.expr(leaves)).alias("__i", "__to")).select(*by, F.expr(f"{at} + __i").alias("__p"), "__to")
    reached = blocks.filter("__k = 0").select(*by, F.lit(0).cast("bigint").alias("__p"))
    exits = stage(exits)
    entries = exits.select(*by, F.col("__to").alias("__p")).distinct().unionByName(reached)
    ahead = stage(exits.join(entries.distinct(), [*by, "__p"], "left_semi"))
    places = ahead.select(*by, "__p")  # targets that are rows
    while True:
        # ``reached`` holds the first 2^k places of every walk, ``ahead`` leads 2^k places on
        led = reached.join(ahead, [*by, "__p"]).select(*by, F.col("__to").alias("__p")).join(places, [*by, "__p"], "left_semi")
        reached = stage(reached.unionByName(led))
        onward = ahead.select(*by, F.col("__p").alias("__to"), F.col("__to").alias("__next"))
        ahead = stage(ahead.join(onward, [*by, "__to"]).select(*by, "__p", F.col("__next").alias("__to")))
        if ahead.isEmpty():
            break
    heads = (f"aggregate(sequence(0, size(__j) - 1), struct(cast(__p - {at} as bigint) as n, cast(array() as array<int>) as h), (t, i) -> "
             "if(i = t.n, struct(i + __j[i] as n, concat(t.h, array(i)) as h), t)).h")
    got = blocks.join(reached.select(*by, F.expr(f"__p div {size}").alias("__k"), "__p"), [*by, "__k"]).withColumn("__h", F.explode(F.expr(heads)))
    return got.select(*by, F.expr(f"{at} + __h").alias(seq), F.expr("__j[__h]").alias(jump))
