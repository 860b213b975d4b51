import pytest

from impactframe import schemas
from impactframe.plans.affected import Index, affected
from impactframe.functions.globs import any_glob


def make(spark, packages, deps=(), targets=(), files=(), items=(), sources=()):
    t = {
        "packages": spark.createDataFrame([(f"id-{n}", n, w, w, f"{r}/Cargo.toml", r) for n, w, r in packages], schemas.PACKAGES),
        "package_dependencies": spark.createDataFrame([(f"id-{a}", f"id-{b}", b, b, k, None) for a, b, k in deps], schemas.PACKAGE_DEPENDENCIES),
        "targets": spark.createDataFrame([(f"t-{n}", f"id-{p}", n, [k], True, s) for p, n, k, s in targets], schemas.TARGETS),
        "files": spark.createDataFrame([(f"f-{p}", p, h, 1) for p, h in files], schemas.FILES),
        "items": spark.createDataFrame(
            [(f"{p}-{n}-{k}", f"f-{p}", k, n, "pub", (s, 1, e, 1), None, test) for p, k, n, s, e, test in items], schemas.ITEMS
        ),
        "source_dependencies": spark.createDataFrame(list(sources), schemas.SOURCE_DEPENDENCIES),
    }
    return Index(spark, t)


CHAIN = [("math", "core", "core/math"), ("state", "sdk", "sdk/state"), ("api", "nodes", "nodes/api"), ("lone", "nodes", "nodes/lone")]
LINKS = [("state", "math", "normal"), ("api", "state", "dev"), ("math", "api", "build")]


def changed(spark, *rows):
    return spark.createDataFrame([(r, []) if isinstance(r, str) else r for r in rows], schemas.CHANGES)


def chain_index(spark, **more):
    files = [(f"{r}/src/lib.rs", "h") for _, _, r in CHAIN] + [(f"{r}/tests/smoke.rs", "h") for _, _, r in CHAIN]
    targets = [(n, n, "lib", f"{r}/src/lib.rs") for n, _, r in CHAIN] + [(n, "smoke", "test", f"{r}/tests/smoke.rs") for n, _, r in CHAIN]
    return make(spark, CHAIN, LINKS, targets, files + list(more.pop("files", ())), **more)


def commands(report):
    return {(r["workspace"], r["mode"], tuple(r["args"])) for r in report.commands.collect()}


def test_closure_crosses_workspaces_and_cycles(spark):
    r = affected(chain_index(spark), changed(spark, "core/math/src/lib.rs"))
    assert r.summary["strategy"] == "closure"
    assert commands(r) == {("core", "package", ("-p", "math")), ("sdk", "package", ("-p", "state")), ("nodes", "package", ("-p", "api"))}
    assert {x["result"] for x in r.checks.collect()} == {"ok"}


def test_modules_narrow_and_one_bad_range_does_not(spark):
    path = "nodes/lone/src/lib.rs"
    index = chain_index(spark, items=[(path, "Mod", "tests", 10, 20, True), (path, "Mod", "tests::deep", 12, 14, True)])
    r = affected(index, changed(spark, (path, [(13, 13), (18, 18)])))
    assert r.summary["strategy"] == "module"
    assert commands(r) == {("nodes", "module", ("-p", "lone", "tests")), ("nodes", "module", ("-p", "lone", "tests::deep"))}
    r = affected(index, changed(spark, (path, [(13, 13), (30, 30)])))
    assert commands(r) == {("nodes", "package", ("-p", "lone"))}


def test_module_without_matching_test_is_widened(spark):
    path = "nodes/lone/src/lib.rs"
    index = chain_index(spark, items=[(path, "Mod", "tests", 10, 20, True)])
    none = spark.createDataFrame([], "workspace string, args array<string>, test string")
    r = affected(index, changed(spark, (path, [(13, 13)])), matched_tests=none)
    row = r.commands.collect()[0]
    assert (row["mode"], row["args"], row["widened_from"]) == ("package", ["-p", "lone"], "module")


def test_target_and_test_source(spark):
    r = affected(chain_index(spark), changed(spark, "core/math/tests/smoke.rs"))
    assert commands(r) == {("core", "test_target", ("-p", "math", "--test", "smoke"))}
    r = affected(chain_index(spark), changed(spark, "core/math/tests/data.txt", "core/math/tests/common/mod.rs"))
    assert r.summary["strategy"] == "test_source_package"
    assert commands(r) == {("core", "package", ("-p", "math"))}


def test_test_only_dependents_are_left_out(spark):
    index = make(spark, CHAIN, [("api", "state", "normal")], [("state", "smoke", "test", "sdk/state/tests/smoke.rs")],
                 [("sdk/state/tests/smoke.rs", "h"), ("core/math/src/lib.rs", "h")])
    r = affected(index, changed(spark, "sdk/state/tests/smoke.rs", "core/math/src/lib.rs"))
    assert commands(r) == {("core", "package", ("-p", "math")), ("sdk", "package", ("-p", "state"))}


@pytest.mark.parametrize("path", ["core/.cargo/config.toml", "rust-toolchain", "elsewhere/data.bin"])
def test_global_widening(spark, path):
    r = affected(chain_index(spark), changed(spark, path))
    assert r.summary["failed_wide"]
    assert commands(r) == {(w, "workspace_wide", ()) for w in ("core", "sdk", "nodes")}


def test_no_changes_widen(spark):
    assert affected(chain_index(spark), changed(spark)).summary == {"failed_wide": True, "reason": "no changed files", "strategy": "workspace_wide"}


def test_unmapped_file_stays_in_its_workspace(spark):
    r = affected(chain_index(spark), changed(spark, "sdk/unknown.bin"))
    assert commands(r) == {("sdk", "workspace_wide", ())}


def test_inert_files_select_nothing(spark):
    r = affected(chain_index(spark), changed(spark, "README.md", ".github/workflows/ci.yml", "web/app.ts"))
    assert commands(r) == set() and not r.summary["failed_wide"]
    assert {x["kind"] for x in r.explanations.collect()} == {"inert"}


def rules(spark, *rows):
    return spark.createDataFrame([(i, "rule", s, any_glob(g), w, p) for i, (s, g, w, p) in enumerate(rows)], schemas.RULES)


def test_rules(spark):
    mapped = rules(spark, ("ignore", ["assets/**"], [], []), ("packages", ["assets/*.bin"], [], ["state"]), ("workspace", ["w/*"], ["nodes"], []))
    r = affected(chain_index(spark), changed(spark, "assets/x.bin"), rules=mapped)
    assert {x[0] for x in commands(r)} == {"sdk", "nodes", "core"}
    r = affected(chain_index(spark), changed(spark, "assets/x.txt"), rules=mapped)
    assert commands(r) == set()
    r = affected(chain_index(spark), changed(spark, "w/a"), rules=mapped)
    assert commands(r) == {("nodes", "package", ("-p", "api", "-p", "lone"))}
    with pytest.raises(ValueError):
        affected(chain_index(spark), changed(spark, "w/a"), rules=rules(spark, ("packages", ["a"], [], ["nobody"])))


def test_included_file_reaches_its_users(spark):
    index = chain_index(spark, sources=[("sdk/state/src/lib.rs", "shared/data.txt", "include_str")])
    r = affected(index, changed(spark, "shared/data.txt"))
    assert {x[0] for x in commands(r)} == {"sdk", "nodes", "core"}
    assert r.explanations.first()["kind"] == "included_source"


def test_manifest_edits(spark):
    index = make(spark, CHAIN, LINKS)
    manifest = spark.createDataFrame([("core/math/Cargo.toml", "[package]\nname='m'\ndescription = 'x'\n[features]\na = []\n")], "path string, content string")
    quiet = affected(index, changed(spark, ("core/math/Cargo.toml", [(3, 3)])), contents=manifest)
    assert quiet.summary["strategy"] == "package_metadata" and commands(quiet) == {("core", "package", ("-p", "math"))}
    loud = affected(index, changed(spark, ("core/math/Cargo.toml", [(5, 5)])), contents=manifest)
    assert {x[0] for x in commands(loud)} == {"core", "sdk", "nodes"}


def test_snapshot_statuses(spark):
    item = lambda s, e: [("a.rs", "Fn", "f", s, e, False)]
    before = make(spark, CHAIN, files=[("a.rs", "1"), ("old.rs", "1")], items=item(1, 3))
    after = make(spark, CHAIN, files=[("a.rs", "2"), ("new.rs", "1")], items=item(1, 3))
    moved = make(spark, CHAIN, files=[("a.rs", "2"), ("new.rs", "1")], items=item(3, 5))
    rows = changed(spark, "a.rs", "old.rs", "new.rs", "nodes/api/Cargo.toml")
    status = lambda index: {r["path"]: (r["status"], r["is_unknown"]) for r in affected(index, rows, base=before).files.collect()}
    first = status(after)
    assert first["a.rs"][0] == "unchanged_structure_modified"
    assert (first["old.rs"][0], first["new.rs"][0]) == ("removed", "added")
    assert first["nodes/api/Cargo.toml"] == ("unknown", False)
    assert status(moved)["a.rs"][0] == "modified"


def test_provider_rows_are_added_not_trusted(spark):
    told = spark.createDataFrame([("nodes", "lone", False)], "workspace string, name string, is_directly_affected boolean")
    r = affected(chain_index(spark), changed(spark, "core/math/src/lib.rs"), provider=told)
    assert ("nodes", "package", ("-p", "api", "-p", "lone")) in commands(r)
    # the provider did not report the other workspaces of selected packages: they run whole
    assert ("core", "workspace_wide", ()) in commands(r) and ("sdk", "workspace_wide", ()) in commands(r)
    assert {x["workspace"]: x["failed_wide"] for x in r.workspaces.collect()} == {"core": True, "sdk": True, "nodes": False}
    assert r.package_reasons.where("name = 'math'").first()["changed_files"] == ["core/math/src/lib.rs"]


def test_equal_module_commands_count_once(spark):
    """A library and an entry point with one module name need one command each name."""
    paths = ["nodes/lone/src/lib.rs", "nodes/lone/src/main.rs"]
    items = [(p, "Mod", f"t{i}", 10 * i + 1, 10 * i + 9, True) for p in paths for i in range(6)]
    index = chain_index(spark, files=[(paths[1], "h")], items=items)
    r = affected(index, changed(spark, *[(p, [(10 * i + 2, 10 * i + 2) for i in range(6)]) for p in paths]))
    assert r.summary["strategy"] == "module" and r.commands.count() == 6


def test_tabs_do_not_make_an_edit_inert(spark):
    text = "[package]\nname = 'm'\n\t[dependencies]\n\treadme = '1'\n\u2003[features]\nx = []\n"
    manifest = spark.createDataFrame([("core/math/Cargo.toml", text)], "path string, content string")
    index = make(spark, CHAIN, LINKS)
    for line in (4, 6):
        r = affected(index, changed(spark, ("core/math/Cargo.toml", [(line, line)])), contents=manifest)
        assert {x[0] for x in commands(r)} == {"core", "sdk", "nodes"}
