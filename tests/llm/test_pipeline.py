import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from speechgrid.llm import language, near_copies, secrets

FOLDER = "/root/testdata/sf0.001"


def shingles(text, size=5):
    w = text.encode().lower().split()
    return {b" ".join(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def components_of(rows, least):
    root = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if root[i] != root[j] and alike(a, b) >= least:
                lo, hi = sorted((root[i], root[j]))
                root = {x: lo if r == hi else r for x, r in root.items()}
    return root


@pytest.fixture(scope="module")
def table_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, owner string, component_id int, score double")
    return make


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "o", 3, 0.5)


def test_near_copies(table_of):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(1, None), (2, " "), (3, "one two"), (4, "ONE  two"), (5, "one two three")]
    for k in range(30):
        base = [word() for _ in range(rng.choice([40, 200, 900]))]
        for c in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 + 10 * k + c, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(table_of([row(i, t) for i, t in [*rows, (None, "one two")]])).collect()}
    want = components_of([(i, t or "") for i, t in rows], 0.8)
    assert {i: got.get(i, i) for i, _ in rows} == want
    assert near_copies.near_copies(table_of([])).count() == 0


def test_one_common_passage_links_nothing(table_of):
    rng = random.Random(1)
    rows = [row(i, "the same opening words of every page " * 3 + " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200))) for i in range(300)]
    assert near_copies.near_copies(table_of(rows)).count() == 0


def test_stages_on_odd_rows(spark, table_of):
    words = "the and with that from this have were been which".split()
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    a, b = text(80), text(80)
    rows = [row(i, text(60)) for i in range(1000, 1060)] + [row(1, a), row(2, a.upper()), row(2, a.upper()), row(3, a + " extra"), row(4, b + ' token = "abcdef012"', None), row(5, None), row(6, ""), row(7, "123"), row(None, b), row(None, b),
                                                           row(8, b), row(9, text(30_000)), row(10, a), row(10, b)]
    docs = table_of(rows)
    kept = corpus_pipeline.known_language(spark, docs, FOLDER)
    assert kept.schema == docs.schema and sorted(set(r.doc_id or 0 for r in docs.collect()) - set(r.doc_id or 0 for r in kept.collect())) == [5, 6, 7]
    one = corpus_pipeline.exact_copies(spark, docs, FOLDER)
    texts = defaultdict(list)
    for r in one.collect():
        texts[(r.text or "").lower()].append(r.doc_id)
    assert all(len(v) == 1 for v in texts.values()) and texts[a.lower()] == [10] and texts[b.lower()] == [10] and texts[""] == [6]
    near = corpus_pipeline.near_duplicates(spark, table_of([row(1, a), row(3, a + " extra"), row(4, b), row(None, a)]), FOLDER)
    assert sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 4]
    masked = {r.doc_id: r for r in corpus_pipeline.secret_masks(spark, table_of([rows[64], row(5, None), row(1, a)]), FOLDER).collect()}
    assert masked[4].text == b + ' [SECRET]"' and masked[4].n_chars == len(masked[4].text) and masked[5].text is None and masked[1].text == a
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table_of([]), FOLDER).count() == 0


def test_run_against_a_plain_version(spark):
    from speechgrid.llm.packing import Tokens

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    model = language.learn(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rejected = {r.doc_id for r in language.identify(spark.read.parquet(f"{FOLDER}/documents.parquet"), model).filter("rejected").collect()}
    best = {}
    for i, t, _ in rows:
        if i not in rejected:
            best[(t or "").lower()] = max(best.get((t or "").lower(), (i, t)), (i, t))
    left = sorted(best.values())
    root = components_of([(i, t or "") for i, t in left], 0.8)
    left = [(i, t) for i, t in left if root[i] == i]
    found = {r.doc_id: r.spans for r in secrets.secret_scan(spark.createDataFrame(left, "doc_id long, text string")).collect()}
    kinds = {k: n for n, k in enumerate(secrets.KINDS)}
    import public_tokenizers

    lib = Tokens(public_tokenizers.path("word_bpe_49k.json")).lib
    want = {}
    for i, t in left:
        spans = [(int(s), kinds[k], int(e)) for k, s, e in (x.split(":") for x in found[i].split(",") if x)]
        ids = [*lib.encode(secrets.mask(t or "", spans, "[SECRET]"), add_special_tokens=False).ids, 2]
        want[i] = (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()[:4 * 4096]))
    got, seqs = {}, defaultdict(list)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        if r.start == 0:
            got[r.doc_id] = (r.doc_tokens, r.ids_crc32)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in seqs.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) <= 4096
