"""The stages over a small table with known cases."""

import os
import random

import corpus_pipeline
from impactframe.llm import packing
from impactframe.llm.storage import durable, settled, shared_dir


def test_stages(spark, documents, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    clean = [(i, f"{words(70)}\n{words(60)}") for i in range(12)]
    passage = words(55)
    shared = [(50, f"{words(60)}\n{passage}"), (51, f"{words(60)}\n{passage}\n{words(20)}")]
    near = clean[3][1].split(" ")
    near[1] = near[-1] = "changed"
    rows = [*clean, *shared, (60, clean[2][1]), (61, " ".join(near)), (70, "too short"), (71, None), (72, "a b c " * 40)]
    docs = documents(rows)
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixing", "packing"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = durable(stage(spark, docs, str(tmp_path)))
        if k < 4:
            assert docs.dtypes == before.dtypes
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    every = {d for d, _ in rows}
    assert set(seen[0]) == every - {70, 71, 72}
    assert set(seen[1]) == set(seen[0]) - {60}
    assert passage in seen[1][50] and passage not in seen[1][51] and all(seen[1][i] == t for i, t in clean)
    assert set(seen[2]) == set(seen[1]) - {61}
    assert set(seen[3]) == set(seen[2])
    ids = packing.tokenizer(packing.default_tokenizer())
    total = sum(len(ids.encode(t)) // 4 + 1 for t in seen[3].values())
    assert sum(r["length"] for r in docs.collect()) >= total


def test_edges_of_every_stage(spark, documents, tmp_path):
    """Empty tables, nulls in every column, clashing columns, repeated rows and a long text."""
    from pyspark.sql import functions as F

    words = lambda k, n: " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}{k}" for i in range(n))
    names = ["clean_text", "runs", "t1", "node", "rate", "posterior", "_d0", "kept", "doc", "lines"]
    rows = [(1, words("p", 90), "en", "s0"), (1, words("p", 90), "en", "s0"), (None, words("q", 90), None, None), (2, None, None, None), (3, "", "en", None)]
    rows += [(4, "\n".join(words(k, 60) for k in "ABCDEFGH") + "\n" + words("r", 600), "en", "s0")]
    spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(rows, names)
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, empty = durable(stage(spark, docs, str(tmp_path))), durable(stage(spark, empty, str(tmp_path)))
        assert empty.count() == 0
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
            assert docs.where(F.col("runs") != "clash").count() == 0
        if k == 2:
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "4", "None"]
        if k == 3:
            mixed = {r["doc_id"] for r in docs.collect()}  # 4 is labelled toxic and may be thinned
    assert mixed >= {1, None} and {r["doc_id"] for r in docs.collect()} == mixed


def _read(df):
    """Names of the written tables that a plan reads."""
    return {part for f in df.inputFiles() for part in f.split("/") if part.startswith("impactframe-")}


def test_stages_leave_only_what_their_results_read(spark, documents):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = words(55)
    texts = [f"{words(60)}\n{words(20)}" for _ in range(6)]
    rows = [*enumerate(texts), (10, f"{words(30)}\n{passage}"), (11, f"{words(30)}\n{passage}"), (12, f"{texts[2]} more")]
    rows += [(None, words(70)), (20, words(70)), (20, words(70))]
    docs = durable(documents(rows))
    for stage, lost in ((corpus_pipeline.line_dedup, set()), (corpus_pipeline.near_duplicates, {12})):
        before = set(os.listdir(shared_dir(spark)))
        out = stage(spark, docs, "")
        left = set(os.listdir(shared_dir(spark))) - before
        assert left and left <= _read(out)
        assert {r["doc_id"] for r in out.collect()} == {d for d, _ in rows} - lost


def test_settled_deletes_what_was_written_on_the_way(spark):
    there = lambda df: _read(df) <= set(os.listdir(shared_dir(spark)))
    first, way = durable(spark.range(5)), []

    def inner():
        way.append(durable(first.where("id > 0")))
        return durable(way[-1].where("id > 1"))

    def outer():
        way.append(settled(inner))
        assert not there(way[0]) and there(way[1])
        return way[1].where("id > 2")

    out = settled(outer)
    assert there(first) and there(out) and not there(way[1])
    assert sorted(r["id"] for r in out.collect()) == [3, 4] and first.count() == 5
