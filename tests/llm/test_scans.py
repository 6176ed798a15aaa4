import hashlib
import random
import re

import pytest

from speechgrid.llm import licenses, secrets


def test_automaton_gives_matching_statistics():
    rng = random.Random(5)
    templates = [[rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(6)]
    a = licenses.Automaton(templates, 1)
    for _ in range(200):
        text = [rng.randrange(5) for _ in range(rng.randint(1, 20))]
        stats = [max([n for n in range(1, p + 2) if any(t[i:i + n] == text[p - n + 1:p + 1] for t in templates for i in range(len(t)))], default=0) for p in range(len(text))]
        want = [(p, n) for p, n in enumerate(stats) if n and (p + 1 == len(text) or stats[p + 1] != n + 1)]
        got = a.runs(text)
        assert [(p, n) for _, p, n in got] == want
        for state, p, n in got:
            run = text[p - n + 1:p + 1]
            assert set(a.ends[state]) == {(k, i + n - 1) for k, t in enumerate(templates) for i in range(len(t) - n + 1) if t[i:i + n] == run}


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


MIT = licenses.TEMPLATES[0][1]


def test_license_scan(docs_of):
    rows = [(1, None), (2, "MIT-License and the mit license; GENERAL PUBLIC LICENSE. É\x7fü"), (3, "x " * 30 + MIT[:400] + " y" * 9), (4, "apache  licenses"), (5, "Licensed under CC BY-NC 4.0."),
            (6, "mit mit license license apache\nLICENSE"), (7, " ".join(MIT.split()[:30] + ["odd"] + MIT.split()[30:])), (7, ""), (None, "mit license"), (8, "the software of the license " * 9000)]
    got = sorted(licenses.license_scan(docs_of(rows)).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] or 0, len(x[1] or ""))), strict=True):
        w = slow_words(t)
        at = [(k, lab) for p, lab in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) == (i, len(w), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0])
        assert r.base_labels == ",".join(sorted({x[1] for x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    by = {(r.doc_id, r.n_words): r for r in got}
    third = next(r for r in got if r.doc_id == 3)
    assert third.labels == "mit" and third.spans[0].first == 30 and 0.6 <= third.score < 1
    assert next(r for r in got if r.doc_id == 5).labels == "cc-by-nc"
    assert next(r for r in got if r.doc_id == 7 and r.n_words).labels == "mit"
    assert by[(8, 45000)].labels == ""
    assert licenses.license_scan(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_base_spans(seed):
    rng = random.Random(seed)
    parts = ["password", "PassWD", "token", "api_key", "APIKEY", "secret", "ſecret", "=", ":", " ", '"', "'", "abc", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n", "f" * 9, "."]
    text = "".join(rng.choice(parts) for _ in range(60))
    want = []
    for k, (p, least) in enumerate(((r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24))):
        want += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[2] if k == 0 else m[0]) >= least]
    assert secrets.base_spans(text) == sorted(want)


def test_secret_scan(docs_of):
    random_part = "Zq8Lr2Xv9Tb4Wn7Kd1Mf6Hs3"
    rows = [(1, None), (2, 'é token = "abcdef" x'), (3, f"the bearer credential is {random_part}, keep it"), (4, f"the wall colour is {random_part}"),
            (5, "auth via client_secret_default_value_1 client_secret_default_value_1"), (5, f"signature {random_part}\n{random_part}"), (None, "AKIA" + "A" * 16), (6, "key " + "word " * 200_000)]
    got = {(r.doc_id, r.spans): r for r in secrets.secret_scan(docs_of(rows), with_text=True).collect()}
    assert set(got) == {(1, ""), (2, "assign:2:17"), (3, "novel:25:49"), (4, ""), (5, ""), (5, "novel:10:34"), (None, "access:0:20"), (6, "")}
    assert got[(2, "assign:2:17")].base_sha256 == hashlib.sha256(b"assign:2:17").hexdigest() and got[(2, "assign:2:17")].masked == 'é [SECRET]" x'
    assert got[(3, "novel:25:49")].base_sha256 == hashlib.sha256(b"").hexdigest() and got[(3, "novel:25:49")].n_novel == 1
    assert secrets.mask("abcdef", [(0, 0, 2), (1, 2, 3), (5, 2, 6)], "_") == "_de_"
    assert secrets.secret_scan(docs_of([])).count() == 0
