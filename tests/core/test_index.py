import json
import subprocess

import pytest

from impactframe.plans import index as indexing
from impactframe.plans import report
from impactframe.plans.affected import affected
from impactframe.sources import changes, scan


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for path, text in {
        "core/math/Cargo.toml": "[package]\nname = 'math'\n",
        "core/math/src/lib.rs": "pub fn add() {}\nmod inner;\n#[cfg(test)]\nmod tests {\n    fn t() {}\n}\n",
        "core/math/src/inner.rs": "pub struct S;\n",
        "core/app/Cargo.toml": "[package]\nname = 'app'\n",
        "core/app/src/main.rs": 'fn main() { include_str!("../../shared.txt"); }\n',
        "core/shared.txt": "x\n",
        "target/skip.rs": "not rust at all {",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git(root.parent, "init", "-q", str(root))
    git(root, "add", "-A")
    git(root, "commit", "-qm", "base")
    return root


def reports(root):
    package = lambda name, kind, src: {
        "id": name, "name": name, "source": None, "manifest_path": f"{root}/core/{name}/Cargo.toml",
        "targets": [{"name": name, "kind": [kind], "src_path": f"{root}/core/{name}/src/{src}", "test": True}],
    }
    return [{
        "workspace_root": f"{root}/core",
        "packages": [package("math", "lib", "lib.rs"), package("app", "bin", "main.rs")],
        "resolve": {"nodes": [{"id": "app", "deps": [{"pkg": "math", "name": "math", "dep_kinds": [{"kind": None, "target": None}]}]}, {"id": "math"}]},
    }]


def test_build_save_update_and_ask(spark, repo, tmp_path):
    root = str(repo)
    made = indexing.build(spark, root, reports(root))
    assert {r["path"] for r in made["files"].collect()} == {"core/math/src/lib.rs", "core/math/src/inner.rs", "core/app/src/main.rs"}
    edges = made["edges"].where("kind = 'ModuleDeclares'").collect()
    assert len(edges) == 1
    assert made["packages"].where("name = 'app'").first()["workspace"] == "core"
    indexing.save(made, str(tmp_path / "cache"))
    loaded = indexing.load(spark, str(tmp_path / "cache"))
    same, decided, mode = indexing.update(spark, root, reports(root), loaded, [])
    assert mode == "warm_unmodified" and {r["decision"] for r in decided.collect()} == {"trusted"}

    (repo / "core/math/src/inner.rs").write_text("pub struct S;\npub struct T;\n")
    rows = changes.worktree(root)
    assert rows == [("core/math/src/inner.rs", [(2, 2)])]
    now, decided, mode = indexing.update(spark, root, reports(root), loaded, [p for p, _ in rows])
    assert mode == "incremental_update"
    assert {r["path"]: r["decision"] for r in decided.collect()}["core/math/src/inner.rs"] == "reparsed"
    assert indexing.summary(now)["items"] == indexing.summary(loaded)["items"] + 1
    answer = affected(now, changes.change_table(spark, rows), base=loaded)
    assert {tuple(r["args"]) for r in answer.commands.collect()} == {("-p", "app", "-p", "math")}
    assert {(r["name"], r["status"]) for r in answer.items.collect()} == {("T", "added")}
    json.dumps(report.as_dict(answer))
    (repo / "core/math/src/inner.rs").unlink()
    (repo / "core/new.rs").write_text("")
    assert sorted(p for p, _ in changes.worktree(root)) == ["core/math/src/inner.rs", "core/new.rs"]
    assert indexing.load(spark, str(tmp_path / "none")) is None


def test_explain_package(spark, repo):
    made = indexing.build(spark, str(repo), reports(str(repo)))
    got = report.explain_package(made, "math")["chains"]
    assert [(r["name"], r["level"], r["via_name"]) for r in got] == [("math", 0, None), ("app", 1, "math")]
    with pytest.raises(ValueError):
        report.explain_package(made, "nobody")


def test_unreadable_source_and_missing_file_fail(spark, repo):
    (repo / "core/math/src/inner.rs").write_text("fn broken( {")
    with pytest.raises(ValueError):
        indexing.build(spark, str(repo), reports(str(repo)))
    (repo / "core/math/src/inner.rs").unlink()
    with pytest.raises(FileNotFoundError):
        indexing.build(spark, str(repo), reports(str(repo)))
    assert "core/math/src/inner.rs" in scan.tracked_paths(str(repo))


def test_git_sources_and_commands(spark, repo, tmp_path, monkeypatch, capsys):
    from impactframe import cli

    root = str(repo)
    git(repo, "checkout", "-qb", "topic")
    (repo / "core/math/src/inner.rs").write_text("pub struct S;\n++ note\npub struct T;\n")
    git(repo, "commit", "-qam", "change")
    assert changes.revisions(root, "HEAD~1", "HEAD") == [("core/math/src/inner.rs", [(2, 2), (3, 3)])]
    assert changes.merge_base(root, "HEAD~1") == changes.revisions(root, "HEAD~1", "HEAD")
    (repo / "core/math/src/inner.rs").write_text("pub struct S;\n")
    git(repo, "add", "-A")
    assert changes.staged(root) == [("core/math/src/inner.rs", [])]
    (tmp_path / "meta.json").write_text(json.dumps(reports(root)[0]))
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    options = ["--root", root, "--metadata", str(tmp_path / "meta.json"), "--cache", str(tmp_path / "cache"), "--format", "json"]
    assert cli.cache_path(root, None) == f"{root}/target/impactframe"
    assert cli.main(["index", *options]) == 0
    assert json.loads(capsys.readouterr().out)["mode"] == "cold_rebuild"
    told = tmp_path / "told"
    told.write_text("""#!/bin/sh\necho '{"affected_crates": [], "affected_workspaces": [{"name": "core", "path": "core"}]}'\n""")
    told.chmod(0o755)
    assert cli.main(["affected", *options, "--staged", "--provider", str(told), "--validate-nextest"]) == 0
    answer = json.loads(capsys.readouterr().out)
    assert [c["args"] for c in answer["commands"]] == [["-p", "app", "-p", "math"]]
    assert {r["name"]: r["changed_files"] for r in answer["package_reasons"]} == dict.fromkeys(["app", "math"], ["core/math/src/inner.rs"])
    assert cli.main(["explain", *options, "--path", "core/shared.txt"]) == 0
    assert json.loads(capsys.readouterr().out)["explanations"][0]["kind"] == "included_source"


def test_trusted_files_are_not_read(spark, repo):
    root = str(repo)
    made = indexing.build(spark, root, reports(root))
    (repo / "core/math/src/lib.rs").write_text("not rust at all {")
    (repo / "core/math/src/inner.rs").write_text("pub struct S2;\n")
    now, decided, mode = indexing.update(spark, root, reports(root), made, ["core/math/src/inner.rs"])
    assert {r["path"]: r["decision"] for r in decided.collect()} == {
        "core/math/src/inner.rs": "reparsed", "core/math/src/lib.rs": "trusted", "core/app/src/main.rs": "trusted",
    }
    assert now["files"].count() == 3 and now["items"].where("name = 'S2'").count() == 1
