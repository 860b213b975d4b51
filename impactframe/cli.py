"""Commands: ``index``, ``affected`` and ``explain``."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import time
from pathlib import Path

from .plans import index as indexing
from .plans import report
from .plans.affected import Index, affected, validate_commands
from .session import local_session
from .sources import changes, config, listings


def metadata_reports(root: str, given: list[str]) -> list[dict]:
    """Package metadata from files, else from the build tool if it is installed."""
    if given:
        return [json.loads(Path(p).read_text()) for p in given]
    from .sources import scan

    texts = {p: (Path(root) / p).read_text() for p in scan.tracked_paths(root) if p.endswith("Cargo.toml")}
    out = []
    for manifest in listings.candidate_manifests(texts):
        command = ["cargo", "metadata", "--format-version", "1", "--manifest-path", f"{root}/{manifest}"]
        out.append(json.loads(subprocess.run(command, capture_output=True, check=True).stdout))
    return out


def cache_path(root: str, given: str | None) -> str:
    place = given or os.path.join(os.environ.get("CARGO_TARGET_DIR", "target"), "impactframe")
    return place if os.path.isabs(place) else os.path.join(root, place)


def collect_changes(args: argparse.Namespace) -> list[tuple]:
    """Rows of the chosen sources. With two revisions the listed files restrict them;
    otherwise sources add up."""
    listed = changes.explicit(args.files)
    if args.stdin:
        listed += changes.parse_changes(sys.stdin.read())
    if args.base and args.head:
        rows = changes.revisions(args.root, args.base, args.head)
        if not listed:
            return rows
        wanted = {p for p, _ in listed}
        inside = [r for r in rows if r[0] in wanted]
        return inside + [(p, []) for p in sorted(wanted - {p for p, _ in inside})]
    rows = listed
    if args.merge_base:
        rows = rows + changes.merge_base(args.root, args.merge_base)
    if args.worktree:
        rows = rows + changes.worktree(args.root)
    if args.staged:
        rows = rows + changes.staged(args.root)
    return rows


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="impactframe")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("index", "affected", "explain"):
        p = sub.add_parser(name)
        p.add_argument("--root", default=os.getcwd())
        p.add_argument("--cache")
        p.add_argument("--metadata", action="append", default=[], help="package metadata JSON, instead of running the tool")
        p.add_argument("--format", choices=["text", "json"], default="text")
        p.add_argument("--output", help="write the JSON report here and show the summary")
        if name == "affected":
            p.add_argument("files", nargs="*")
            p.add_argument("--stdin", action="store_true")
            p.add_argument("--base")
            p.add_argument("--head")
            p.add_argument("--merge-base")
            p.add_argument("--worktree", action="store_true")
            p.add_argument("--staged", action="store_true")
            p.add_argument("--base-cache")
            p.add_argument("--provider", help="program that lists affected packages (ripples) and all workspaces (lineup) as JSON")
            p.add_argument("--validate-nextest", action="store_true", help="list the tests of module commands and widen those without any")
        if name == "explain":
            p.add_argument("--path")
            p.add_argument("--package")
    return top


def show(args: argparse.Namespace, value: dict) -> None:
    text = json.dumps(value, indent=2, default=str)
    if args.output:
        Path(args.output).write_text(text + "\n")
    print(text if args.format == "json" and not args.output else report.as_text(value))


def current_index(spark, args: argparse.Namespace, changed: list[str]) -> tuple[Index, str]:
    cache = cache_path(args.root, args.cache)
    reports = metadata_reports(args.root, args.metadata)
    previous = indexing.load(spark, cache)
    if previous is None:
        made, mode = indexing.build(spark, args.root, reports), "cold_rebuild"
    else:
        made, _, mode = indexing.update(spark, args.root, reports, previous, changed)
    if mode != "warm_unmodified":
        indexing.save(made, cache)
    return made, mode


def provider_tables(spark, args: argparse.Namespace, paths: list[str]):
    """Packages (workspace, name, is_directly_affected) and reported workspaces."""
    told = listings.provided(args.root, args.provider, sorted(set(paths)))
    return (
        spark.createDataFrame(told["packages"], "workspace string, name string, is_directly_affected boolean"),
        spark.createDataFrame(told["workspaces"], "workspace string, workspace_path string"),
    )


def with_workspaces(spark, index: Index, workspaces: list[tuple[str, str]]):
    """The packages of the index, and a row without a name for each listed workspace that has
    none, so that widening reaches it."""
    listed = spark.createDataFrame(workspaces, "workspace string, workspace_path string")
    more = listed.join(index["packages"].select("workspace"), "workspace", "left_anti")
    return index["packages"].unionByName(more, allowMissingColumns=True)


def listed_tests(spark, root: str, index: Index, answer):
    """(workspace, module_filter, test) of the tests that each module command matches; a
    command whose lister fails matches none. There are at most eight commands a package."""
    places = {r["workspace"]: r["workspace_path"] for r in index["packages"].select("workspace", "workspace_path").distinct().collect()}
    rows = []
    for r in answer.commands.where("mode = 'module'").collect():
        tests = listings.list_tests(root, places[r["workspace"]], r["args"]) if r["workspace"] in places else None
        rows += [(r["workspace"], r["args"], t) for t in tests or []]
    return spark.createDataFrame(rows, "workspace string, args array<string>, test string")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.root = str(Path(args.root).resolve())
    spark = local_session()
    began = time.time()
    if args.command == "index":
        made, mode = current_index(spark, args, [])
        show(args, {"mode": mode, **indexing.summary(made), "elapsed_ms": int((time.time() - began) * 1000)})
        return 0
    rules = config.load_optional(args.root)
    options = {"rules": rules.table(spark), "default_inert": rules.default_inert_paths}
    if args.command == "explain":
        made, _ = current_index(spark, args, [args.path] if args.path else [])
        show(args, report.explain_package(made, args.package) if args.package else report.explain_path(made, args.path, **options))
        return 0
    rows = collect_changes(args)
    error = None
    try:
        made, _ = current_index(spark, args, [p for p, _ in rows])
    except (ValueError, FileNotFoundError) as failure:
        made, error = Index(spark), f"the index could not be built: {failure}"
        made.tables["packages"] = listings.package_tables(spark, args.root, metadata_reports(args.root, args.metadata))[0]
    base = indexing.load(spark, args.base_cache) if args.base_cache else None
    if base is not None and not error and base["meta"].first()["package_hash"] != made["meta"].first()["package_hash"]:
        base = None
    texts = [(p, (Path(args.root) / p).read_text()) for p, _ in rows if p.endswith("Cargo.toml") and (Path(args.root) / p).is_file()]
    contents = spark.createDataFrame(texts, "path string, content string")
    if args.provider:
        try:
            options["provider"], options["reported"] = provider_tables(spark, args, [p for p, _ in rows])
        except (OSError, subprocess.CalledProcessError, ValueError, KeyError) as failure:
            error = error or f"the provider gave no answer: {failure}"
            widened = listings.every_workspace(args.root, args.provider)
            made.tables["packages"] = with_workspaces(spark, made, widened)
    answer = affected(made, changes.change_table(spark, rows), base=base, contents=contents, index_error=error, **options)
    if args.validate_nextest:
        answer.commands = validate_commands(answer.commands, listed_tests(spark, args.root, made, answer))
    show(args, report.as_dict(answer))
    return 0


if __name__ == "__main__":
    sys.exit(main())
