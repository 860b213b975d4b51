import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from impactframe.llm import packing

TEXTS = ["", "Hello, WORLD! it's 42", "<|endoftext|> x<|startoftext|>", "ΣΑΣ ﬁ é a\x85b\x1cc İ ǅ 漢字½", "a\tb\nc  d", "don't we'll " * 3]


def reference(texts):
    t = Tokenizer.from_file(packing.default_tokenizer())
    return [np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for x in texts]


def test_ids_equal_the_tokenizer():
    words = packing.tokenizer(packing.default_tokenizer())
    for text, ids in zip(TEXTS, reference(TEXTS), strict=True):
        assert words.encode(text) == ids[:-1].tobytes()


def test_round_trip(documents):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.choice([3, 200, 900, 5000]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "no id")]
    out = packing.pack(documents(rows, ["start", "ids"])).collect()
    ids = dict(zip([d for d, _ in rows], reference([t or "" for _, t in rows]), strict=True))
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_length"] <= packing.WINDOW and at & (at - 1) == 0
    assert packing.pack(documents([])).count() == 0


def brute_choice(counts, size, window):
    best = None
    for level in range(window - size + 1):
        if level and not counts[level]:
            continue
        after = counts.copy()
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] += 1
        cost = int((after[1:window] ** 2).sum())
        if best is None or cost <= best[0]:
            best = (cost, level)
    return best[1]


@pytest.mark.parametrize("seed", range(3))
def test_sum_of_squares_choice(seed):
    rng = random.Random(seed)
    p = packing.LevelPacker(16, max_open=1000)
    for i in range(300):
        size = rng.randint(1, 15)
        assert p.choose(size) == brute_choice(p.counts, size, 16)
        list(p.add(i, bytes(4 * size)))


def test_few_ids_are_moved_at_the_end():
    rng = random.Random(1)
    sizes = [min(int(rng.lognormvariate(5.6, 1.0)) + 1, 2000) for _ in range(30_000)]
    left = []
    for lo in range(0, len(sizes), 500):
        first = packing.LevelPacker(passing=True)
        for i in range(lo, lo + 500):
            list(first.add(i, bytes(4 * sizes[i])))
        left += first.take()
    second = packing.LevelPacker()
    rows = [r for piece in left for r in second.put(piece)]
    rows += list(second.close())
    assert sum(r[2] for r in rows) == sum(len(p[2]) for p in left) // 4
    assert second.moved < 0.02 * sum(sizes)
    total = {}
    for r in rows:
        total[r[5]] = total.get(r[5], 0) + r[2]
    assert sum(x < packing.WINDOW for x in total.values()) <= 11 and all(x & (x - 1) == 0 for x in total.values())


def test_repeated_rows_groups_and_full_packers(documents):
    rows = [(7, "alpha beta " * (20 + i % 40)) for i in range(60)] * 2 + [(1, "gamma " * 60_000)]
    out = packing.pack(documents(rows), max_open=4, group_ids=1500).collect()
    ids = [len(x) for x in reference([t for _, t in rows])]
    assert sum(r["length"] for r in out) == sum(ids)
    ends = {}
    for r in out:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in ends.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= packing.WINDOW


def test_closing_early_loses_nothing():
    p = packing.LevelPacker(16, max_open=3)
    rows = [r for i in range(50) for r in p.add(i, bytes(4 * (9 + i % 5)))] + list(p.close())
    assert sum(r[2] for r in rows) == sum(9 + i % 5 for i in range(50)) and p.open == 0
