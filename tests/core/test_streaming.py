import json

from impactframe.streaming.feed import answer_feed, change_feed, merged_feed
from tests.core.test_affected import chain_index


def test_each_batch_is_answered(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"path": "nodes/lone/src/lib.rs", "ranges": []}) + "\n")
    seen = {}

    def sink(report, number):
        seen[number] = {tuple(r["args"]) for r in report.commands.collect()}

    query = answer_feed(change_feed(spark, str(folder)), chain_index(spark), sink, str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert list(seen.values()) == [{("-p", "lone")}]


def test_batches_are_merged_by_path(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    rows = [{"path": "a", "ranges": [{"start_line": 3, "end_line": 4}]}, {"path": "a", "ranges": [{"start_line": 1, "end_line": 1}]}, {"path": "", "ranges": []}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
    out = []
    query = merged_feed(change_feed(spark, str(folder)), lambda df, _: out.extend(df.collect()), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert [(r["path"], [tuple(x) for x in r["ranges"]]) for r in out] == [("a", [(1, 1), (3, 4)])]
