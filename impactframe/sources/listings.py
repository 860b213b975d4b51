"""Tables from other tools: package metadata and test listings."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = "`rust-suites` map<string, struct<testcases map<string, struct<`filter-match` struct<status string>>>>>"
PACKAGES = "id string, name string, workspace string, workspace_path string, manifest_path string, root_path string"
TARGETS = "id string, package_id string, name string, kind array<string>, test boolean, src_path string"
DEPENDENCIES = "package_id string, depends_on_package_id string, name string, depends_on_path string, kind string, target string"


def matching_tests(df: DataFrame, listing: str, *keys: str) -> DataFrame:
    """(keys, suite, test) of the test cases whose filter matches."""
    suites = df.select(*keys, F.explode(F.from_json(listing, LISTING)["rust-suites"]).alias("suite", "v"))
    cases = suites.select(*keys, "suite", F.explode("v.testcases").alias("test", "c"))
    return cases.where(F.col("c.filter-match.status") == "matches").select(*keys, "suite", "test").distinct()


def list_tests(root: str, workspace_path: str, args: list[str], program: str = "cargo") -> list[str] | None:
    """Names of the tests that a command's arguments match, from the test lister in the
    workspace's folder, sorted; None if the lister is missing, fails or answers no JSON."""
    command = [program, "nextest", "list", "--message-format", "json", *args]
    try:
        out = subprocess.run(command, cwd=os.path.join(root, workspace_path), capture_output=True, check=True).stdout
        answer = json.loads(out)
    except (OSError, subprocess.CalledProcessError, ValueError):
        return None
    suites = answer.get("rust-suites") if isinstance(answer, dict) else None
    cases = [s.get("testcases") for s in suites.values()] if isinstance(suites, dict) else []
    return sorted({
        name for own in cases if isinstance(own, dict) for name, case in own.items()
        if ((case or {}).get("filter-match") or {}).get("status") == "matches"
    })


def _json_block(text: str, program: str) -> dict:
    """The JSON object in a program's answer, from the first ``{`` to the last ``}``."""
    first, last = text.find("{"), text.rfind("}")
    if first < 0 or last < first:
        raise ValueError(f"{program} answered no JSON object")
    return json.loads(text[first : last + 1])


def provided(root: str, program: str, paths: list[str]) -> dict[str, list[tuple]]:
    """What an external program says that ``paths`` affect: ``packages`` (workspace, name,
    is_directly_affected) and ``workspaces`` (name, path). It is run as ``PROGRAM ripples
    --format json PATHS``; an answer that cannot be had is an error."""
    run = subprocess.run([program, "ripples", "--format", "json", *paths], cwd=root, capture_output=True, check=True)
    answer = _json_block(run.stdout.decode(errors="replace"), program)
    rows = answer.get("affected_crates", [])
    return {
        "packages": sorted({(r["workspace"], r["name"], bool(r.get("is_directly_affected"))) for r in rows}),
        "workspaces": sorted({(r["name"], r["path"]) for r in answer.get("affected_workspaces", [])}),
    }


def every_workspace(root: str, program: str) -> list[tuple[str, str]]:
    """(name, path) of all workspaces by ``PROGRAM lineup --format json``, to widen to."""
    run = subprocess.run([program, "lineup", "--format", "json"], cwd=root, capture_output=True, check=True)
    return sorted({(r["name"], r["path"]) for r in _json_block(run.stdout.decode(errors="replace"), program).get("workspaces", [])})


def _relative(path: str, root: str) -> str | None:
    root = root.rstrip("/")
    if path == root:
        return ""
    return path[len(root) + 1 :] if path.startswith(root + "/") else None


def package_tables(spark: SparkSession, root: str, reports: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages, targets and dependencies from build-tool metadata reports: local packages
    under ``root``, one report for each workspace root, edges once for each kind and
    target platform (``normal`` where none is named)."""
    packages: dict[str, tuple] = {}
    targets: dict[tuple, tuple] = {}
    edges: set[tuple] = set()
    seen: set[str] = set()
    for report in reports:
        workspace_root = report["workspace_root"]
        where = _relative(workspace_root, root)
        if workspace_root in seen or where is None:
            continue
        seen.add(workspace_root)
        local = {}
        for p in report["packages"]:
            manifest = _relative(p["manifest_path"], root)
            if p.get("source") is None and manifest is not None:
                local[p["id"]] = (p, manifest)
        by_root = {m.rpartition("/")[0]: p["name"] for p, m in local.values()}
        workspace = by_root.get(where) or where.rpartition("/")[2] or "root"
        for key, (p, manifest) in local.items():
            packages.setdefault(key, (key, p["name"], workspace, where, manifest, manifest.rpartition("/")[0]))
            for t in p.get("targets", []):
                src = _relative(t["src_path"], root)
                if src is not None:
                    targets.setdefault((key, t["name"], tuple(t["kind"])), (f"{key}#{t['name']}#{','.join(t['kind'])}", key, t["name"], list(t["kind"]), bool(t.get("test", True)), src))
        for node in (report.get("resolve") or {}).get("nodes", []):
            if node["id"] not in local:
                continue
            for d in node.get("deps", []):
                if d["pkg"] in local:
                    for kind in d.get("dep_kinds") or [{}]:
                        edges.add((node["id"], d["pkg"], d["name"], local[d["pkg"]][1].rpartition("/")[0], kind.get("kind") or "normal", kind.get("target") or ""))
    rows = [(*e[:5], e[5] or None) for e in sorted(edges)]
    return (
        spark.createDataFrame(list(packages.values()), PACKAGES),
        spark.createDataFrame(list(targets.values()), TARGETS),
        spark.createDataFrame(rows, DEPENDENCIES),
    )


def candidate_manifests(manifests: dict[str, str]) -> list[str]:
    """Workspace manifests, and manifests beneath no workspace's directory."""
    workspaces = sorted(m for m, text in manifests.items() if "[workspace]" in text)
    roots = [m.rpartition("/")[0] for m in workspaces]
    owned = lambda m: any(r == "" or m.startswith(r + "/") for r in roots)
    return workspaces + sorted(m for m in manifests if m not in workspaces and not owned(m))
