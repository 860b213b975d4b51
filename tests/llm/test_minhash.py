import random
import re

import pytest

from impactframe.llm import components, minhash
from impactframe.llm.components import connected_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    least = {d: d for d, _ in sets}
    changed = True
    links = [
        (a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and 100 * len(s & t) >= percent * len(s | t)
    ]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least, {d: len(s) for d, s in sets}


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz")
    rows, families = [], [[word() for _ in range(rng.randint(20, 120))] for _ in range(6)]
    for i in range(n):
        words = list(rng.choice(families))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = word()
        rows.append((i * 2, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "one"), (503, "ONE "), (504, "one two"), (505, " \n")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(documents, k, percent):
    rows = texts(k)
    least, size = brute(rows, k, percent)
    out = minhash.near_duplicates(documents(rows, ["node", "keys", "n"]), k, percent).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (least[r["doc_id"]], size[r["doc_id"]], least[r["doc_id"]] == r["doc_id"])


def test_edges(documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (7, text), (8, text), (8, "unlike " * 9), (9, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(rows), 3, 85).collect()), key=str)
    assert got == sorted([(7, 7, True), (8, 7, False), (8, 7, False), (9, 9, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(documents([]), 3, 85).count() == 0
    assert {r["doc_id"] for r in minhash.keep_one(documents(rows[1:3])).collect()} == {7}


def test_keep_one_leaves_one_row_of_a_document(documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, a), (8, b), (None, c), (None, c), (None, b + " end"), (9, "two"), (9, "texts"), (None, None), (None, "")]
    docs = documents(rows, ["t1", "row"])
    out = minhash.keep_one(docs)
    assert out.dtypes == docs.dtypes
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    nine = [r for r in got if r[0] == 9]
    assert len(nine) == 1 and nine[0] in rows
    assert sorted(set(got) - set(nine), key=str) == sorted([(7, a), (8, b), (None, c), (None, None), (None, "")], key=str)
    assert len(got) == 6
    assert len(minhash.keep_one(documents([(None, a), (None, a)])).collect()) == 1


def test_bitmap_bound_keeps_links():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.concatenate([a[: len(a) - 10], rng.integers(0, 2**63, 10).astype(np.uint64)])
        x, y = minhash._bitmap(a), minhash._bitmap(b)
        both = sum(int(p & q).bit_count() for p, q in zip(x[:-1], y[:-1], strict=True))
        most = both + min(len(a) - int(x[-1]), len(b) - int(y[-1]))
        assert most >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    assert got == least


def test_words_that_collide_in_polynomial_hashes_are_not_equal(documents):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x y"), (2, f"{other} x y"), (3, f"{word} X y")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(rows), 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_template_pages_and_long_texts(documents):
    """Pages alike at 0.7, never linked, among them links that only the exact round finds."""
    rng = random.Random(8)
    shared = [f"t{i}" for i in range(140)]
    rows = [(i, " ".join(shared + [f"p{i}_{j}" for j in range(30)])) for i in range(60)]
    rows += [(100 + i, " ".join([*rows[i][1].split()[:-2], "x", "y"])) for i in range(0, 60, 7)]
    long = [f"l{rng.randrange(5000)}" for _ in range(30_000)]
    rows += [(200, " ".join(long)), (201, " ".join([*long[:-40], "end"])), (202, " ".join(long[::-1]))]
    least, size = brute(rows, 3, 85)
    assert len(set(least.values())) > 60
    for r in minhash.near_duplicates(documents(rows), 3, 85).collect():
        assert (r["component_id"], r["n_shingles"]) == (least[r["doc_id"]], size[r["doc_id"]])


def jobs_of(spark, run):
    context = spark.sparkContext
    group = f"counted-{random.random()}"
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_small_tables_take_few_jobs(spark, documents):
    """Each job over a small table costs as much as its tasks, however few its rows are."""
    docs = documents(texts(3))
    assert jobs_of(spark, lambda: minhash.near_duplicates(docs, 3, 85).collect()) <= 110


@pytest.mark.parametrize("at_most", [0, 1_000_000])
def test_components_on_the_driver_and_by_steps_are_equal(spark, documents, monkeypatch, at_most):
    monkeypatch.setattr(components, "DRIVER_EDGES", at_most)
    edges = [(1, 2), (2, 1), (3, 3), (None, 5), (5, None), *[(i + 1, i) for i in range(10, 40)], *[(90, i) for i in range(50, 90)]]
    got = {(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    wanted = {(1, 1), (2, 1), *[(i, 10) for i in range(10, 41)], *[(i, 50) for i in range(50, 91)]}
    assert got == wanted
    assert connected_components(spark.createDataFrame([(4, 4)], "u long, v long")).collect() == []


def test_rows_of_one_doc_id_are_linked_whatever_they_hold(documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(8, a), (8, None), (8, b), (5, b), (6, c), (6, ""), (9, a + " end"), (7, None), (None, a)]
    out = minhash.near_duplicates(documents(rows), 3, 85).collect()
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"], r["n_shingles"]) for r in out)
    linked = [("8", 5, False, n) for n in (0, 28, 28)] + [("5", 5, True, 28), ("6", 6, True, 28), ("6", 6, True, 0), ("9", 5, False, 29)]
    assert [x for x in got if x[0] != "None"] == sorted([*linked, ("7", 7, True, 0)])
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)]
