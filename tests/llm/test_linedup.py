import random

import pytest

from impactframe.llm import linedup


def worded(text):
    return [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]


def brute(docs, least):
    """Deleted line numbers by (doc_id, text): every maximal match with an earlier place."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    places = [(k, i) for k, d in enumerate(order) for i in range(len(worded(d[1])))]
    lines = [worded(d[1]) for d in order]
    gone = {k: set() for k in range(len(order))}
    for a, (k, i) in enumerate(places):
        for k2, i2 in places[:a]:
            n = 0
            while (
                i + n < len(lines[k]) and i2 + n < len(lines[k2]) and lines[k][i + n] == lines[k2][i2 + n]
            ):
                n += 1
            if n and sum(len(x.split()) for x in lines[k][i : i + n]) >= least:
                gone[k].update(range(i, i + n))
    return {order[k]: gone[k] for k in gone}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(9)]
    rows = []
    for d in range(25):
        lines = [rng.choice([*pool, "", " "]) if rng.random() < 0.85 else f"own {d} {i}" for i in range(rng.randint(0, 12))]
        rows.append((d * 3, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, rows[4][1] + "\n" + rows[5][1]), (7, None)]
    least = [4, 9, 15][seed]
    out = linedup.deduplicate_lines(documents(rows), least).collect()
    want = brute([(d, t or "") for d, t in rows], least)
    assert len(out) == len(rows)
    for r in out:
        gone = want[(r["doc_id"], r["text"] or "")]
        left = [x for i, x in enumerate(worded(r["text"])) if i not in gone]
        assert worded(r["clean_text"]) == left, r
        assert r["n_removed"] == len(gone)


def test_edge_cases(spark, documents):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"head\n{long}\ntail"), (2, f"other\n{long}"), (2, f"other\n{long}"), (None, long), (3, ""), (4, None)]
    got = {(r["doc_id"], r["text"]): r for r in linedup.deduplicate_lines(documents(rows, ["t1", "runs", "n_runs"])).collect()}
    assert got[1, rows[0][1]]["n_removed"] == 0
    assert got[2, rows[1][1]]["clean_text"] == "other"
    assert got[None, long]["clean_text"] == ""
    assert got[3, ""]["clean_text"] == got[4, None]["clean_text"] == ""
    assert got[1, rows[0][1]]["t1"] == "clash"
    assert linedup.deduplicate_lines(documents([])).count() == 0


def test_same_row_twice_is_one_document(spark, documents):
    text = "\n".join(f"line {i} " + "word " * 20 for i in range(4))
    out = linedup.deduplicate_lines(documents([(5, text), (5, text)])).collect()
    assert [r["n_removed"] for r in out] == [0, 0]


def test_repeats_within_a_document_overlap(spark, documents):
    out = linedup.deduplicate_lines(documents([(1, "\n".join(["a b"] * 7))]), 4).collect()[0]
    assert out["clean_text"] == "a b"


def brute_edges(docs, least):
    """``brute``, and lines with ``least`` equal words around them and an earlier copy."""
    gone = brute(docs, least)
    seen = []
    for d in sorted(gone, key=lambda d: (d[0] is None, d[0] or 0, d[1] or "")):
        words, at = d[1].split(), 0
        for i, line in enumerate(worded(d[1])):
            n = len(line.split())
            for other, words2, at2 in seen:
                if other != line:
                    continue
                left = right = 0
                while left < min(at, at2) and words[at - left - 1] == words2[at2 - left - 1]:
                    left += 1
                while at + n + right < len(words) and at2 + n + right < len(words2) and words[at + n + right] == words2[at2 + n + right]:
                    right += 1
                if n < least <= left + n + right:
                    gone[d].add(i)
            seen.append((line, words, at))
            at += n
    return gone


@pytest.mark.parametrize("seed", range(2))
def test_edges_equal_brute_force(spark, documents, seed):
    rng = random.Random(10 + seed)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    rows = [(d * 3, "\n".join(rng.choice([*pool, f"own{d}", ""]) for _ in range(rng.randint(0, 10)))) for d in range(25)]
    rows += [(100, rows[3][1]), (100, rows[3][1])]
    least = [6, 9][seed]
    want = brute_edges(rows, least)
    assert want != brute(rows, least)
    for r in linedup.deduplicate_lines(documents(rows), least, edges=True).collect():
        gone = want[(r["doc_id"], r["text"])]
        assert worded(r["clean_text"]) == [x for i, x in enumerate(worded(r["text"])) if i not in gone], r


def test_equal_words_beside_a_line_count(spark, documents):
    words = [f"w{i}" for i in range(59)]
    text = lambda a, b: f"{a} {' '.join(words[:17])}\n{' '.join(words[17:42])}\n{' '.join(words[42:])} {b}"
    rows = [(1, text("one", "two")), (2, text("three", "four")), (3, "x\n" + " ".join(words[17:42]) + "\ny")]
    got = {r["doc_id"]: r for r in linedup.deduplicate_lines(documents(rows), edges=True).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 1, 0]
    assert worded(got[2]["clean_text"]) == [worded(rows[1][1])[0], worded(rows[1][1])[2]]


def test_runs_of_any_depth_and_long_texts(spark, documents):
    """Copied runs of 200 one-word lines and of 3,000 lines, cut at other places each time."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choice(words) for _ in range(400)]
    long = [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(3_000)]
    rows = [(1, "\n".join(base)), (2, "\n".join(["x", *base[50:250], "y", *base[20:70]])), (3, "\n".join([*base[100:130], "z", *base[300:]]))]
    rows += [(4, "\n".join(long)), (5, "\n".join(["head", *long[500:2_900], "tail", *long[:30]])), (6, "\n".join(base))]
    out = {r["doc_id"]: r for r in linedup.deduplicate_lines(documents(rows), 50).collect()}
    small = brute([r for r in rows if r[0] not in (4, 5)], 50)
    for d, text in rows:
        if d not in (4, 5):
            gone = small[d, text]
            assert worded(out[d]["clean_text"]) == [x for i, x in enumerate(worded(text)) if i not in gone], d
    assert out[4]["n_removed"] == 0 and out[6]["clean_text"] == ""
    assert worded(out[5]["clean_text"]) == ["head", "tail"] and out[5]["n_runs"] == 2


def test_equal_lines_overlap_their_own_copy(documents):
    out = linedup.deduplicate_lines(documents([(1, "\n".join(["w"] * 51)), (2, "\n".join(["v"] * 50))])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, 50), (2, 0)]


def test_common_prefixes_hold_no_broadcast_of_every_level(spark):
    """Small levels are broadcast; one plan with those of all levels filled the driver's heap."""
    words = ["abcabcabcabx", "bcabcabcabcaz", "abcabcy"]
    rows = [(doc, 0, i, len(w) - i, ord(c)) for doc, w in enumerate(words) for i, c in enumerate(w)]
    lines = spark.createDataFrame(rows, "doc long, island long, line int, rem int, rank long")
    levels, _ = linedup.suffix_ranks(lines, 13)
    assert len(levels) == 2
    order = sorted((words[doc][line:], doc, line, rem) for doc, _, line, rem, _ in rows)
    kept = [x for i, x in enumerate(order) if i == 0 or x[0] != order[i - 1][0]]
    entries = spark.createDataFrame([(f, doc, line, rem) for f, (_, doc, line, rem) in enumerate(kept)], "f long, doc long, line int, rem int")
    found = linedup.common_prefixes(entries, levels)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Join") == 0
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    wanted = {f: shared(kept[f - 1][0], kept[f][0]) if f else 0 for f in range(len(kept))}
    assert {r["f"]: r["lcp"] for r in found.collect()} == wanted
