"""Segmentation: scenario lines with the units worked out by hand, and properties on longer transcripts."""

import random

import pytest
from pyspark.sql import functions as F

from speechgrid.operators import segment as sg

WORDS = "media_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint, conf double"
TURNS = "media_id bigint, speaker string, start_ms bigint, end_ms bigint"


def talk(*parts, at=0, word=300, gap=50):
    """Words and turns from (speaker, text) parts; a number between parts is a pause in milliseconds."""
    words, turns, t = [], [], at
    for p in parts:
        if isinstance(p, int):
            t += p
            continue
        speaker, text = p
        a = t
        for w in text.split():
            words.append((w, t, t + word))
            t += word + gap
        turns.append((speaker, a, t - gap))
    return words, turns


def run(spark, cases, fn=sg.segment, overlaps=None):
    w = [(m, i, *x, 0.9) for m, (ws, _) in enumerate(cases) for i, x in enumerate(ws)]
    t = [(m, *x) for m, (_, ts) in enumerate(cases) for x in ts]
    words = spark.createDataFrame(w, WORDS)
    turns = spark.createDataFrame(t, TURNS)
    ov = None if overlaps is None else spark.createDataFrame([(m, *x) for m, ts in enumerate(overlaps) for x in ts], TURNS)
    got = {m: [] for m in range(len(cases))}
    for r in fn(words, turns, overlaps=ov).orderBy("media_id", "id").collect():
        got[r.media_id].append((r.speaker, r.text, list(r.breaks), list(r.anchors), r.cut_off))
    return got


def plain(units):
    return [(s, t) for s, t, *_ in units]


CASES = {
    "two sentences": (talk(("A", "This is the first long sentence we say. Then comes another long one right here.")),
                      [("A", "This is the first long sentence we say."), ("A", "Then comes another long one right here.")]),
    "abbreviation and a.m. run on": (talk(("A", "We met Dr. Rao at 9 a.m. with friends from the old town office.")),
                                     [("A", "We met Dr. Rao at 9 a.m. with friends from the old town office.")]),
    "flip takes the flanking speaker": (talk(("A", "we were going to the big"), ("B", "market"), ("A", "to buy some fruit and rice today.")),
                                        [("A", "we were going to the big market to buy some fruit and rice today.")]),
    "an answer stands": (talk(("A", "Did you really go to the market this morning?"), 400, ("B", "Yes."), 400, ("A", "That is good to hear from you today.")),
                         [("A", "Did you really go to the market this morning?"), ("B", "Yes."), ("A", "That is good to hear from you today.")]),
    "an interjected backchannel is dropped": (talk(("A", "I went there with all of my friends,"), 350, ("B", "mm-hmm"), 350, ("A", "and we stayed until the evening came.")),
                                              [("A", "I went there with all of my friends, and we stayed until the evening came.")]),
    "long pause after complete speech": (talk(("A", "We stopped."), 1600, ("A", "Next we talked about the other plan.")),
                                         [("A", "We stopped."), ("A", "Next we talked about the other plan.")]),
    "a pause inside a sentence is a break": (talk(("A", "and the answer we found was"), 1600, ("A", "forty two in the end.")),
                                             [("A", "and the answer we found was forty two in the end.")]),
    "turn change snaps to the sentence end": (talk(("A", "so then we ran the whole model"), ("B", "locally. Did you see how fast it was on that laptop?")),
                                              [("A", "so then we ran the whole model locally."), ("B", "Did you see how fast it was on that laptop?")]),
    "one word": (talk(("A", "Hello.")), [("A", "Hello.")]),
    "words in no turn": ((talk(("A", "Nobody was heard here at all today."))[0], []), [("S1", "Nobody was heard here at all today.")]),
    "a limit cut inside a sentence rejoins up to twenty seconds": (
        talk(("A", " ".join(["word"] * 20) + " comma, " + " ".join(["more"] * 25) + " end.")),
        [("A", " ".join(["word"] * 20) + " comma, " + " ".join(["more"] * 25) + " end.")]),
}


@pytest.fixture(scope="module")
def units(spark):
    got = run(spark, [c for c, _ in CASES.values()])
    return dict(zip(CASES, got.values()))


@pytest.mark.parametrize("name", list(CASES))
def test_scenarios(units, name):
    assert plain(units[name]) == CASES[name][1]


def test_breaks_and_anchors(units):
    (_, _, breaks, anchors, _), = units["a pause inside a sentence is a break"]
    assert breaks == [6] and anchors == []


def test_cut_off(spark):
    got = run(spark, [talk(("A", "I wanted to tell you about it and"), 100, ("B", "No, let me go first this time, please.")),
                      talk(("A", "What time does the train leave from here"), 400, ("B", "It leaves at noon from the main station."))])
    assert [u[4] for u in got[0]] == [True, False]
    assert [u[4] for u in got[1]] == [False, False]


def test_crosstalk_keeps_a_turn(spark):
    w, t = talk(("A", "we were going to the big"), ("B", "market"), ("A", "to buy some fruit and rice today."))
    b = t[1]
    got = run(spark, [(w, t)], overlaps=[[t[0], b, ("A", t[0][1], t[2][2])]])
    assert [s for s, *_ in got[0]] == ["A", "B", "A"]


def test_group_cuts_at_the_clause(spark):
    ws, ts = talk(("A", " ".join(["word"] * 20) + " comma, " + " ".join(["more"] * 25) + " end."))
    words = spark.createDataFrame([(0, i, *x, 0.9) for i, x in enumerate(ws)], WORDS)
    turns = spark.createDataFrame([(0, *x) for x in ts], TURNS)
    g = sg.group_chunks(sg.label_chunks(words, turns, sg.chunk_cuts(words)), until="group")
    assert [len(x.ix) for x in g.first().GR] == [21, 26]


def random_transcript(seed):
    rnd = random.Random(seed)
    words, turns, t = [], [], 0
    for _ in range(rnd.randint(3, 14)):
        speaker, a = rnd.choice("ABC"), t
        for _ in range(rnd.randint(1, 30)):
            w = rnd.choice(["so", "the", "Model", "runs", "yeah", "mm-hmm", "it", "Priya", "twenty", "five", "ok", "and"]) + rnd.choice(["", "", "", ",", ".", "?"])
            d = rnd.randint(80, 500)
            words.append((w, t, t + d))
            t += d + rnd.choice([0, 40, 120, 320, 700, 1100, 1700])
        turns.append((speaker, max(a - rnd.randint(0, 300), 0), t + rnd.randint(-200, 200)))
    return words, turns


def test_lossless_bounded_and_partition_independent(spark):
    from speechgrid.functions.words import BACKCHANNELS

    cases = [random_transcript(s) for s in range(40)]
    w = spark.createDataFrame([(m, i, *x, 0.9) for m, (ws, _) in enumerate(cases) for i, x in enumerate(ws)], WORDS)
    t = spark.createDataFrame([(m, *x) for m, (_, ts) in enumerate(cases) for x in ts], TURNS)
    a = sg.segment(w, t).select("media_id", "id", "speaker", "start_ms", "end_ms", "text", F.expr("transform(words, x -> x.idx)").alias("ix")).orderBy("media_id", "id").collect()
    b = sg.segment(w.repartition(5), t.repartition(3)).select("media_id", "id", "speaker", "start_ms", "end_ms", "text",
                                                              F.expr("transform(words, x -> x.idx)").alias("ix")).orderBy("media_id", "id").collect()
    assert a == b
    for m, (ws, _) in enumerate(cases):
        mine = [r for r in a if r.media_id == m]
        seen = [i for r in mine for i in r.ix]
        assert len(seen) == len(set(seen))
        lost = set(range(len(ws))) - set(seen)
        assert all(ws[i][0].lower().strip(".,!?") in BACKCHANNELS for i in lost)
        for r in mine:
            assert r.end_ms - r.start_ms <= 20_000 or len(r.ix) == 1
            assert list(r.ix) == sorted(r.ix)
