import hashlib
import unicodedata

import pytest

from impactframe.llm import fingerprints as fp

ROWS = [
    (1, "Hello  World"), (2, "hello\tworld "), (3, None), (5, ""), (9, "Straße ﬁn"), (11, "STRASSE fin"), (12, "x" * 50_000),
    (20, "日本語テキスト"), (21, "a"), (22, "ab"), (30, "hello world"), (31, "é" * 7), (32, "é" * 7),
]


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


@pytest.mark.parametrize("bits", [128, 2])
def test_equals_brute_force(documents, bits):
    out = {r["doc_id"]: r for r in fp.fingerprint_documents(documents(ROWS, ["digest", "bucket", "key"]), bits).collect()}
    assert len(out) == len(ROWS)
    order = sorted(ROWS, reverse=True)
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = out[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canonical(edited) == canonical(text))
        assert r["near_next"] == float(canonical(following) == canonical(text))
    for a, s in ROWS:
        for b, t in ROWS:
            same = canonical(s or "") == canonical(t or "")
            assert (out[a]["fingerprint"] == out[b]["fingerprint"]) == same, (a, b)


def test_edges(documents):
    one = fp.fingerprint_documents(documents([(4, "same")])).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["near_edited"] == 0.0
    assert fp.fingerprint_documents(documents([])).count() == 0
    rows = fp.fingerprint_documents(documents([(None, "x y"), (3, "b"), (3, "a"), (3, "a")])).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in rows) == [(False, 1)] * 3 + [(True, 3)]


def test_hot_copies(documents):
    rows = [(i, "copy of one text") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(100)]
    out = fp.fingerprint_documents(documents(rows)).collect()
    assert len(out) == 400 and len({r["fingerprint"] for r in out}) == 101
