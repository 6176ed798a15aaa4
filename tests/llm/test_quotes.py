import random

import pytest

from speechgrid.llm import quotes


def rows_of(df):
    return {(r.conv_id, r.turn): r for r in df.collect()}


@pytest.fixture(scope="module")
def table_of(spark):
    def make(rows):
        return spark.createDataFrame([(c, t, "user", x, 1, 2, "h", "s") for c, t, x in rows], "conv_id long, turn long, role string, text string, thread int, depth int, hash string, source string")
    return make


def test_parse():
    text, passages = quotes.parse("Bob wrote:\n> > old  Words\n>\n> newer\n> lines\nmy own\n\nwords wrote: no")
    assert text == "my own\n\nwords wrote: no"
    levels = {}
    for level, h in passages:
        levels.setdefault(level, set()).add(h)
    d = quotes._digest
    assert levels == {2: {d("OLD words")}, 1: {d("newer lines"), d("newer"), d("lines")}, 0: {d("my own"), d("words wrote: no")}}
    assert quotes.parse("no quotes \n") == ("no quotes \n", [(0, d("no quotes"))])
    assert quotes.parse("") == ("", []) and quotes.parse("> \n>>") == ("", [])


def test_reply_order(table_of):
    rows = [(1, 0, "first thing\nsecond thing"), (1, 1, "other talk"), (1, 2, "> Second   THING\nyes"), (1, 3, "On Monday A wrote:\n>> second thing\n> yes\nagreed"), (1, 4, "> never said\nhm"), (1, 5, "> other talk\n> yes"),
            (2, 0, "> yes"), (2, 1, "yes"), (2, 2, "> yes"), (2, 2, "> yes"), (3, 0, None), (3, 1, ""), (None, 1, "> yes"), (4, None, "yes"), (5, 1, "x " * 100_000), (5, 9000, "> " + "x " * 100_000 + "\nok"), (6, 1, "> me\nme")]
    got = quotes.reply_order(table_of(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): (r.thread, r.reply_to, r.depth, r.n_linked, r.text) for r in got if r.conv_id is not None and r.conv_id not in (5,)}
    assert by == {(1, 0): (0, None, 0, 0, "first thing\nsecond thing"), (1, 1): (1, None, 0, 0, "other talk"), (1, 2): (0, 0, 1, 1, "yes"), (1, 3): (0, 2, 2, 2, "agreed"), (1, 4): (4, None, 0, 0, "hm"),
                  (1, 5): (0, 2, 2, 2, ""), (2, 0): (0, None, 0, 0, ""), (2, 1): (1, None, 0, 0, "yes"), (2, 2): (1, 1, 1, 1, ""), (3, 0): (0, None, 0, 0, ""), (3, 1): (1, None, 0, 0, ""),
                  (4, None): (None, None, 0, 0, "yes"), (6, 1): (1, None, 0, 0, "me")}
    assert next(r for r in got if r.turn == 9000).reply_to == 1 and next(r for r in got if r.conv_id is None).text == ""
    assert quotes.reply_order(table_of([])).count() == 0


@pytest.mark.parametrize("stretch", [3, 4096])
def test_against_brute_force(table_of, stretch):
    rng, rows = random.Random(stretch), []
    for c in range(4):
        for t in range(40):
            lines = [rng.choice(["", "> ", "> ", "> > "]) + rng.choice(["alpha", "beta b", "gamma", "delta", "eps", f"own {t}", f"own {rng.randint(0, 40)}"]) for _ in range(rng.randint(1, 3))]
            rows.append((c, t, "\n\n".join(lines)))
    parent = {}
    parsed = {(c, t): quotes.parse(x)[1] for c, t, x in rows}
    for (c, t), passages in parsed.items():
        found = [(level, -s) for level, h in passages if level for s in [max((u for u in range(t) if (0, h) in parsed[c, u]), default=None)] if s is not None]
        parent[c, t] = -min(found)[1] if found else None
    got = rows_of(quotes.reply_order(table_of(rows), stretch=stretch))
    for (c, t), p in parent.items():
        depth, root = 0, t
        while parent[c, root] is not None:
            depth, root = depth + 1, parent[c, root]
        assert (got[c, t].reply_to, got[c, t].thread, got[c, t].depth) == (p, root, depth), (c, t)
