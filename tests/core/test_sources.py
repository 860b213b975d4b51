import re

import pytest
from pyspark.sql import functions as F

from impactframe.functions import classes, paths
from impactframe.functions.globs import glob_regex
from impactframe.functions.manifests import manifest_changes
from impactframe.operators import groups
from impactframe.plans.report import as_text
from impactframe.sources import changes, config, listings


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("*.md", ["a.md", "x/a.md"], ["a.mdx"]),
        ("docs/**", ["docs/a", "docs/a/b"], ["docs", "x/docs/a"]),
        ("**/gen/*.rs", ["gen/a.rs", "x/y/gen/a.rs"], ["xgen/a.rs"]),
        ("a?c", ["abc", "a/c"], ["ac"]),
        ("[!ab]x", ["cx"], ["ax"]),
        ("{a,b*}/x", ["a/x", "bcd/x"], ["c/x"]),
        ("a.b+c", ["a.b+c"], ["axb+c"]),
    ],
)
def test_globs(glob, yes, no):
    pattern = re.compile(glob_regex(glob))
    assert all(pattern.match(p) for p in yes) and not any(pattern.match(p) for p in no)


@pytest.mark.parametrize("glob", ["[ab", "{a", "a}"])
def test_bad_globs(glob):
    with pytest.raises(ValueError):
        glob_regex(glob)


def test_change_texts():
    assert changes.parse_changes(" a b.rs \n\nc.rs\n") == [("a b.rs", []), ("c.rs", [])]
    assert changes.parse_changes('["a","b"]') == [("a", []), ("b", [])]
    assert changes.parse_changes('{"changed_files":[{"path":"a","ranges":[{"start_line":3,"end_line":5},{"start":7},{"end":1}]}],"other":["x"]}') == [
        ("a", [(3, 5), (7, 7)])
    ]


def test_config():
    text = '[[rules]]\npaths=["a/*"]\nselection="ignore"\n[[build-script-inputs]]\npaths=["p"]\npackages=["x"]\n'
    rules = config.parse(text).rules
    assert [(r[0], r[1], r[2]) for r in rules] == [(0, "rule", "ignore"), (0, "build_script_input", "packages")]
    for bad in ('x=1', '[[rules]]\npaths=[]\nselection="ignore"', '[[rules]]\npaths=["a"]\nselection="other"', '[[rules]]\npaths=["["]\nselection="ignore"',
                '[[rules]]\npaths=["a"]\nselection="packages"'):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_path_columns(spark):
    rows = [(" ././a\\b// ",), ("/a",), ("a/../../b",), ("",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    got = df.select(paths.clean(F.col("p")).alias("c"), paths.normalize(F.col("p")).alias("n")).collect()
    assert [r["c"] for r in got] == ["a/b", "/a", "a/../../b", "", None]
    assert [r["n"] for r in got][1:] == [None, None, "", None]
    kinds = spark.createDataFrame([("x/prebuild.rs",), ("a/.cargo/config",), ("rust-toolchain.toml",), ("x",)], "p string")
    assert [r[0] for r in kinds.select(classes.build_input_kind(F.col("p"))).collect()] == ["build_script", "cargo_config", "toolchain", None]


def test_manifest_kinds(spark):
    text = "[package]\nname='a'\n[features]\nx=[]\n[target.'cfg(unix)'.dependencies]\nb='1'\n[profile.dev]\nopt=1\n[package.metadata.x]\ny=1\n[workspace]\nz=1"
    contents = spark.createDataFrame([("m", text)], "path string, content string")
    rows = spark.createDataFrame([("m", [(4, 12)]), ("n", [(1, 1)]), ("o", [])], changes.SCHEMA)
    got = {r["path"]: r for r in manifest_changes(rows, contents).collect()}
    assert got["m"]["kinds"] == ["features", "manifest_other", "profiles", "target_specific_dependencies", "workspace_inheritance"]
    assert not got["m"]["is_inert"] and len(got["n"]["kinds"]) == 5 and not got["o"]["is_inert"]
    quiet = spark.createDataFrame([("m", [(9, 10)])], changes.SCHEMA)
    assert manifest_changes(quiet, contents).first()["is_inert"]


def test_quantifiers_over_nothing(spark):
    row = spark.createDataFrame([], "x int").agg(groups.every(F.col("x") > 0).alias("e"), groups.some(F.col("x") > 0).alias("s")).first()
    assert row["e"] is True and row["s"] is False


def test_provider_json_with_noise(spark):
    df = spark.createDataFrame([('log {no\n{"n": ["a"], "m": {"k": 1}} tail',), ("none",)], "t string")
    good = spark.createDataFrame([('log\n{"n": ["a"]} tail',)], "t string")
    assert changes.provider_report(good, "t", "n array<string>").first()["n"] == ["a"]
    assert changes.provider_report(df, "t", "n array<string>").count() == 2


def test_candidate_manifests():
    texts = {"a/Cargo.toml": "[workspace]", "a/x/Cargo.toml": "", "b/Cargo.toml": "", "ab/Cargo.toml": ""}
    assert listings.candidate_manifests(texts) == ["a/Cargo.toml", "ab/Cargo.toml", "b/Cargo.toml"]


def test_text_report():
    assert as_text({"a": True, "b": None, "c": [1, 2], "d": "x"}) == "a: true\nb: -\nc: 2\nd: x"


def test_added_lines_of_a_patch():
    patch = "--- a/x.rs\n+++ b/x.rs\n@@ -0,0 +1,3 @@\n+++ note\n+-- b\n+last\n\\ No newline at end of file\n"
    patch += '--- "a/\\303\\274 \\"q\\".rs"\n+++ "b/\\303\\274 \\"q\\".rs"\n@@ -4 +7 @@ fn\n--- old\n+++ new\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n'
    assert list(changes.added_lines(patch)) == [("x.rs", 1), ("x.rs", 2), ("x.rs", 3), ('ü "q".rs', 7)]


def test_json_of_any_depth(spark):
    deep = "[" * 12 + '"p", {"files": [[{"path": "q"}]]}' + "]" * 12
    df = spark.createDataFrame([(1, deep), (2, "no json"), (3, None), (4, "[]"), (5, '"r"')], "k int, t string")
    assert sorted((r["k"], r["path"]) for r in changes.json_path_rows(df, "k", "t").collect()) == [(1, "p"), (1, "q"), (5, "r")]
    assert changes.json_path_rows(df.where("false"), "k", "t").count() == 0


def test_rules_in_blocks(spark, monkeypatch):
    from impactframe.operators import joins

    monkeypatch.setattr(joins, "RULES", 3)
    rules = spark.createDataFrame([(i, "rule", f"^a.*{i}$") for i in range(20)], "rule_index int, source string, regex string")
    paths = spark.createDataFrame([(f"a{i}",) for i in range(30)], "path string")
    got = sorted((r["path"], r["rule_index"]) for r in joins.rule_matches(paths, "path", rules, "regex").collect())
    assert got == sorted((f"a{i}", k) for i in range(30) for k in range(20) if f"a{i}".endswith(str(k)))


def test_spans_equal_brute_force(spark):
    import random

    from impactframe.operators import joins

    rng = random.Random(2)
    span = lambda n: [(i, i % 3, s, s + rng.choice([-1, 0, 0, 1, 5, 40, 900])) for i in range(n) for s in [rng.randint(-50, 1000)]]
    a, b = span(80), [*span(80), (900, 1, None, 5)]
    points = spark.createDataFrame(a, "p int, k int, a int, b int")
    spans = spark.createDataFrame(b, "q int, k int, s int, e int")
    pairs = lambda f, test: sorted((r["p"], r["q"]) for r in f(points, spans, ["k"], "a", "b", "s", "e").collect()) == sorted(
        (p, q) for p, k, x, y in a for q, k2, s, e in b if k == k2 and s is not None and s <= e and x <= y and test(x, y, s, e)
    )
    assert pairs(joins.overlapping_spans, lambda x, y, s, e: s <= y and e >= x)
    points = points.where("a <= b")
    assert pairs(joins.containing_spans, lambda x, y, s, e: s <= x and e >= y)


def program(tmp_path, name, body):
    path = tmp_path / name
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(0o755)
    return str(path)


def test_provider_and_lister_programs(tmp_path):
    answer = '{"affected_crates": [{"name": "a", "workspace": "w", "is_directly_affected": true}], "affected_workspaces": [{"name": "w", "path": "x"}], "workspaces": [{"name": "v", "path": ""}]}'
    told = program(tmp_path, "told", f"echo 'log $@'; cat <<'E'\n{answer}\nE\n")
    assert listings.provided(str(tmp_path), told, ["a.rs"]) == {"packages": [("w", "a", True)], "workspaces": [("w", "x")]}
    assert listings.every_workspace(str(tmp_path), told) == [("v", "")]
    with pytest.raises(ValueError):
        listings.provided(str(tmp_path), program(tmp_path, "mute", "echo nothing"), [])
    suite = '{"rust-suites": {"s": {"testcases": {"t2": {"filter-match": {"status": "matches"}}, "t1": {"filter-match": {"status": "matches"}}, "no": {"filter-match": {"status": "mismatch"}}}}, "u": {}}}'
    (tmp_path / "w").mkdir()
    assert listings.list_tests(str(tmp_path), "w", ["-p", "a"], program(tmp_path, "lister", f"cat <<'E'\n{suite}\nE\n")) == ["t1", "t2"]
    assert listings.list_tests(str(tmp_path), "w", [], program(tmp_path, "fails", "exit 3")) is None
    assert listings.list_tests(str(tmp_path), "w", [], str(tmp_path / "missing")) is None
