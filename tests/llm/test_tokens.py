import hashlib
import random

import pytest

from speechgrid.llm import pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return pieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))


def same(encoder, library, text):
    ids, n, decoded = encoder.encode(text)
    want = library.encode(text)
    assert ids == ",".join(map(str, want)), text
    assert n == len(want) and decoded == library.decode(want), text


@pytest.mark.parametrize("text", ["", " ", "   ", "a", " a", "a  b   c    d ", "a\nb\r\n\tc", "a▁b ▁", "▁", "é ﬁ ½ ²", "中文 x 漢字かな", "a\x00b\x7f", "<s></s><unk><0x41>", "हिन्दी में क्या", "สวัสดี",
                                  "👩‍👩‍👧 x", "...!!! -- __init__(self, x):", "aaaaaaaaaaaaaaaa", "▁▁a", "don't we're", "http://www.example.com/a_b-c?d=e&f=1.2", "é̀"])
def test_edge_texts(encoder, library, text):
    same(encoder, library, text)


@pytest.mark.parametrize("seed", range(30))
def test_random_texts(encoder, library, seed):
    rng = random.Random(seed)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoin ", "ab", "thein g", " .,;-_=/()[]{}'\"0123456789abcXYZ", "éèàüßñ aeiou", "".join(library.id_to_piece(rng.randrange(259, 32000)) for _ in range(40))]
    for a in alphabets:
        same(encoder, library, "".join(rng.choice(a) for _ in range(rng.randint(1, 120))))
    same(encoder, library, "".join(library.id_to_piece(rng.randrange(259, 32000)) for _ in range(60)))


def test_documents(spark, encoder, library):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        same(encoder, library, t)


def test_cache_is_bounded(library):
    import public_tokenizers

    small = pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"), cached=50)
    rng = random.Random(1)
    for _ in range(50):
        same(small, library, " ".join("".join(rng.choice("abcdeo") for _ in range(rng.randint(1, 7))) for _ in range(30)))
    assert len(small.cache) <= 50 + 30 and len(small.fits) <= 50


def test_piece_encode(docs_of, library):
    rows = [(1, None), (2, ""), (3, "the same"), (3, "the same"), (None, "x y"), (4, "word " * 100_000), (5, "abc" * 50_000)]
    got = sorted(pieces.piece_encode(docs_of(rows)).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    want = sorted(((i, library.encode(t or "")) for i, t in rows), key=lambda x: (x[0] or 0, len(x[1])))
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (i, len(ids), ids, library.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.piece_encode(docs_of([])).count() == 0
