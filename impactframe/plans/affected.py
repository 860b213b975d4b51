"""What a set of changes affects: explanations, selection, commands and self-checks.

The answer is widened whenever a narrow one cannot be shown to be complete. All steps are
DataFrames over the index tables; the driver sees one row of flags that picks the strategy
and the depth of the closure loop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import classes, paths
from ..functions.manifests import manifest_changes
from ..operators import decisions, diff, graph, groups, joins
from ..session import durable

WIDE_KINDS = ["cargo_config", "toolchain"]
BUILD_KINDS = ["manifest", "lockfile", "build_script", *WIDE_KINDS]


@dataclass
class Index:
    """The tables of one snapshot; missing ones are empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], schemas.TABLES[name])
        return self.tables[name]


@dataclass
class Report:
    """Results of one question; every member but the flags is a DataFrame."""

    summary: dict
    explanations: DataFrame
    files: DataFrame
    items: DataFrame
    packages: DataFrame
    workspaces: DataFrame
    commands: DataFrame
    checks: DataFrame
    chains: DataFrame
    rules: DataFrame
    package_reasons: DataFrame


def dependency_edges(index: Index) -> DataFrame:
    return index["package_dependencies"].select(
        F.col("package_id").alias("src"), F.col("depends_on_package_id").alias("dst")
    )


def owners(index: Index, table: DataFrame, path: str = "path", distinct: bool = False) -> DataFrame:
    """(path, owner): the package whose root is the deepest above the path. ``distinct``: the
    table has each path once."""
    roots = index["packages"].select(F.col("root_path").alias("_root"), F.col("id").alias("owner"))
    asked = table.select(path) if distinct else table.select(path).distinct()
    return joins.longest_prefix_join(asked, path, roots, "_root", "owner").select(path, "owner")


def configured(changes: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Matching rules of every path: (path, rule_index, source, selection, workspaces, packages)."""
    spark = changes.sparkSession
    rules = rules if rules is not None else spark.createDataFrame([], schemas.RULES)
    return joins.rule_matches(changes.select("path").distinct(), "path", rules, "regex").drop("regex")


def explain_inputs(
    index: Index, changes: DataFrame, rules: DataFrame | None = None, default_inert: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(path, kind, reason, owner, failed_wide) of every path, first class that fits; and
    (path, package_id, is_direct) of the packages that each path reaches."""
    return _explained(index, changes, durable(configured(changes, rules)), default_inert)[:2]


def classify_inputs(index: Index, changes: DataFrame, rules: DataFrame | None = None, default_inert: bool = True) -> DataFrame:
    """The first table of ``explain_inputs`` alone, for which no closure is walked."""
    return _classified(index, changes, durable(configured(changes, rules)), default_inert)[0]


def _explained(index: Index, changes: DataFrame, matches: DataFrame, default_inert: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``explain_inputs`` from rule matches, and the closure (seed, node) of the packages that
    a path reaches directly and of those that own a path: all that later steps ask for."""
    explained, included_by = _classified(index, changes, matches, default_inert)
    return (explained, *_reached(index, matches, explained, included_by))


def _classified(index: Index, changes: DataFrame, matches: DataFrame, default_inert: bool) -> tuple[DataFrame, DataFrame]:
    """The explanation of every path, and (path, package_id) of the packages that include it."""
    changed = durable(changes.select("path").distinct())
    by_rule = decisions.rule_precedence(matches, "path", "selection").select("path", F.col("is_inert").alias("_ignore"))
    indexed = index["files"].select("path").distinct().withColumn("_indexed", F.lit(True))
    included = index["source_dependencies"].groupBy(F.col("target_path").alias("path")).agg(
        groups.some(F.col("kind") == "path_module").alias("_module")
    )
    users = index["source_dependencies"].select(F.col("target_path").alias("path"), "source_path").distinct()
    own = owners(index, changed, distinct=True)
    source_owner = owners(index, users.select(F.col("source_path").alias("path")).distinct()).select(
        F.col("path").alias("source_path"), F.col("owner").alias("package_id")
    )
    included_by = users.join(source_owner, "source_path").where("package_id is not null").select("path", "package_id").distinct()
    any_user = included_by.select("path").distinct().withColumn("_used", F.lit(True))
    base = (
        own.join(by_rule, "path", "left").join(indexed, "path", "left")
        .join(included, "path", "left").join(any_user, "path", "left")
    )
    p = F.col("path")
    build = classes.build_input_kind(p)
    known = F.col("_indexed").isNotNull() | F.col("_module").isNotNull()
    has_owner = F.col("owner").isNotNull()
    inert = classes.inert_class(p)
    may_be_inert = F.lit(default_inert) & ~known & ~has_owner & build.isNull() & inert.isNotNull()
    kind = decisions.ladder(
        (F.col("_ignore"), "inert"),
        (F.col("_ignore").isNotNull(), "configured_repository_input"),
        (build.isNotNull(), "build_input"),
        (F.col("_module"), "path_module"),
        (F.col("_module").isNotNull(), "included_source"),
        (F.col("_indexed"), "rust_source"),
        (classes.is_generated(p), "generated"),
        (may_be_inert, "inert"),
        (has_owner & F.endswith(p, F.lit(".rs")), "rust_source"),
        (has_owner, "package_input"),
        otherwise="uncertain",
    )
    kind = F.when(kind == "build_input", build).otherwise(kind)
    lost = ~has_owner & (F.col("_used").isNull())
    wide = (
        kind.isin("generated", "uncertain", *WIDE_KINDS)
        | (kind.isin(BUILD_KINDS) & ~has_owner)
        | (kind.isin("path_module", "included_source", "rust_source") & lost)
    )
    reason = F.when(kind == "inert", F.when(F.col("_ignore"), "configured as ignored").otherwise(inert)).otherwise(kind)
    final = F.when(kind == "generated", "uncertain").otherwise(kind)
    explained = durable(base.select("path", final.alias("kind"), reason.alias("reason"), "owner", F.coalesce(wide, F.lit(False)).alias("failed_wide")))
    return explained, included_by


def _reached(index: Index, matches: DataFrame, explained: DataFrame, included_by: DataFrame) -> tuple[DataFrame, DataFrame]:
    chosen = matches.where("selection <> 'ignore'")
    named = chosen.select("path", F.explode("packages").alias("name")).join(index["packages"].select("name", F.col("id").alias("package_id")), "name")
    placed = chosen.select("path", F.explode("workspaces").alias("workspace")).join(
        index["packages"].select("workspace", F.col("id").alias("package_id")), "workspace"
    )
    is_rule = explained.where("kind = 'configured_repository_input'").select("path")
    by_owner = explained.where(
        ~F.col("kind").isin("inert", "uncertain", "configured_repository_input", *WIDE_KINDS) & F.col("owner").isNotNull()
    ).select("path", F.col("owner").alias("package_id"))
    by_use = included_by.join(
        explained.where(F.col("kind").isin("path_module", "included_source", "rust_source")).select("path"), "path", "left_semi"
    )
    direct = durable(
        by_owner.unionByName(by_use)
        .unionByName(named.join(is_rule, "path", "left_semi").select("path", "package_id"))
        .distinct()
    )
    seeds = direct.select(F.col("package_id").alias("seed")).unionByName(explained.where("owner is not null").select(F.col("owner").alias("seed")))
    closure = durable(graph.reverse_closure(dependency_edges(index), seeds.distinct()))
    whole = placed.join(is_rule, "path", "left_semi").select("path", "package_id")
    # pairs can meet twice only where a path has several packages or rules: all others are
    # distinct as the closure has them, and are not shuffled by pair
    many = direct.groupBy("path").agg(F.count("*").alias("_n")).where("_n > 1").select("path").unionByName(whole.select("path")).distinct()
    ways = lambda some: some.join(closure, some["package_id"] == closure["seed"]).select("path", F.col("node").alias("package_id"), "seed")
    once = ways(direct.join(many, "path", "left_anti")).select("path", "package_id", (F.col("package_id") == F.col("seed")).alias("is_direct"))
    shared = direct.join(many, "path", "left_semi")
    merged = (
        shared.withColumn("is_direct", F.lit(True))
        .unionByName(ways(shared).drop("seed").unionByName(whole).withColumn("is_direct", F.lit(False)))
        .groupBy("path", "package_id")
        .agg(F.bool_or("is_direct").alias("is_direct"))
    )
    return once.unionByName(merged), closure


def unknown_rules(index: Index, rules: DataFrame | None) -> list[str]:
    """Package names in rules that no package has; such rules are an error."""
    if rules is None:
        return []
    named = rules.select(F.explode("packages").alias("name")).distinct()
    return sorted(r["name"] for r in named.join(index["packages"].select("name"), "name", "left_anti").collect())


def test_sources(index: Index, paths_owned: DataFrame) -> DataFrame:
    """``paths_owned(path, owner)`` with flags: is_test_source, is_bin_entry, is_test_target,
    is_src, is_build (metadata or build file), relative."""
    packages = index["packages"].select(F.col("id").alias("owner"), "root_path", "manifest_path")
    targets = index["targets"]
    kinds = ("test", "bench", "example")
    is_test = F.exists("kind", lambda k: k.isin(*kinds))
    owned = paths_owned.join(packages, "owner", "left")
    relative = paths.relative_to(F.col("path"), F.col("root_path"))
    sources = targets.groupBy(F.col("src_path").alias("path")).agg(
        F.bool_or(is_test).alias("_t"), F.bool_or(~is_test).alias("_p"),
        F.bool_or(F.array_contains("kind", "test")).alias("_tt"), F.bool_or(F.array_contains("kind", "bin")).alias("_b"),
    )
    inside = targets.where(~is_test).join(packages.withColumnRenamed("owner", "package_id"), "package_id").where(
        F.startswith(paths.relative_to(F.col("src_path"), F.col("root_path")), F.lit("tests/"))
    ).select(F.col("package_id").alias("owner")).distinct().withColumn("_lib_in_tests", F.lit(True))
    joined = owned.withColumn("relative", relative).join(sources, "path", "left").join(inside, "owner", "left")
    under = F.startswith("relative", F.lit("tests/"))
    test_source = (F.coalesce("_t", F.lit(False)) | (F.col("relative") == "tests.rs") | under) & ~F.coalesce("_p", F.lit(False)) & ~(
        under & F.coalesce("_lib_in_tests", F.lit(False))
    )
    return joined.select(
        "path",
        "owner",
        "relative",
        F.coalesce(test_source, F.lit(False)).alias("is_test_source"),
        F.coalesce("_b", F.lit(False)).alias("is_bin_entry"),
        F.coalesce("_tt", F.lit(False)).alias("is_test_target"),
        F.coalesce((F.col("relative") == "src.rs") | F.startswith("relative", F.lit("src/")), F.lit(False)).alias("is_src"),
        F.coalesce((F.col("path") == F.col("manifest_path")) | F.col("relative").isin("Cargo.lock", "build.rs"), F.lit(False)).alias("is_build"),
    )


def module_hits(index: Index, changes: DataFrame) -> DataFrame:
    """(path, all_inside, modules): whether every changed range lies in a test module, and
    the innermost ones. Files without ranges have none."""
    modules = index["items"].where("is_test and kind = 'Mod'").join(index["files"].select("file_id", "path"), "file_id").select(
        "path", F.col("name").alias("module"), F.col("span.start_line").alias("s"), F.col("span.end_line").alias("e")
    )
    ranges = changes.select("path", F.explode("ranges").alias("r")).select("path", F.col("r.start_line").alias("a"), F.col("r.end_line").alias("b")).distinct()
    pairs = joins.containing_spans(ranges, modules, ["path"], "a", "b", "s", "e")
    best = joins.innermost(pairs, ["path", "a", "b"], "module")
    return (
        ranges.join(best, ["path", "a", "b"], "left")
        .groupBy("path")
        .agg(groups.every(F.col("module").isNotNull()).alias("all_inside"), groups.collect_sorted(F.col("module")).alias("modules"))
    )


def _command(df: DataFrame, mode: str, reason: str, args: Column, module: Column | None = None, files: Column | None = None) -> DataFrame:
    return df.select(
        "workspace",
        F.lit(mode).alias("mode"),
        args.cast("array<string>").alias("args"),
        (module if module is not None else F.lit(None).cast("string")).alias("module_filter"),
        F.lit(None).cast("string").alias("widened_from"),
        F.array().cast("array<string>").alias("matched_tests"),
        F.lit(reason).alias("reason"),
        (files if files is not None else F.array().cast("array<string>")).alias("changed_files"),
    )


def package_commands(packages: DataFrame, wide: DataFrame, reason: str) -> DataFrame:
    """One ``-p`` command a workspace, or a whole-workspace one where it is wide."""
    narrow = packages.join(wide.select("workspace"), "workspace", "left_anti")
    per = groups.grouped_arguments(narrow, ["workspace"], "name")
    whole = wide.select("workspace").distinct()
    return _command(per, "package", reason, F.col("args")).unionByName(
        _command(whole, "workspace_wide", "workspace could not be narrowed", F.array())
    )


def affected(
    index: Index,
    changes: DataFrame,
    base: Index | None = None,
    rules: DataFrame | None = None,
    contents: DataFrame | None = None,
    provider: DataFrame | None = None,
    reported: DataFrame | None = None,
    default_inert: bool = True,
    matched_tests: DataFrame | None = None,
    index_error: str | None = None,
) -> Report:
    """Answer for ``changes(path, ranges)`` on the current index, with the base snapshot,
    rules, contents of changed files, a provider's packages (workspace, name,
    is_directly_affected) and the workspaces it reported (those of its packages, unless
    given), and the tests (workspace, args, test) that module commands matched, where given."""
    spark = changes.sparkSession
    changes = durable(groups.merge_ranges(changes.withColumn("path", paths.clean(F.col("path")))))
    contents = contents if contents is not None else spark.createDataFrame([], "path string, content string")
    everything = index["packages"].select("workspace", "name", F.col("id").alias("package_id"))
    spaces = index["packages"].select("workspace", "workspace_path").distinct()

    missing = unknown_rules(index, rules)
    if missing:
        raise ValueError(f"rules name unknown packages: {', '.join(missing)}")
    matches = durable(configured(changes, rules))
    explained, reached, closure = _explained(index, changes, matches, default_inert)
    reached = durable(reached)
    matches = joins.ordered_matches(matches, "path")
    flagged = durable(test_sources(index, owners(index, changes)))

    files, items = _snapshot_status(index, base, changes, flagged)
    unknown = files.where("is_unknown").join(explained.where("not failed_wide").select("path"), "path", "left_anti")
    unknown = durable(
        joins.longest_prefix_join(unknown.select("path"), "path", spaces.select(F.col("workspace_path").alias("_root"), "workspace"), "_root", "workspace").select("path", "workspace")
    )
    first = explained.agg(
        F.count("*").alias("n"),
        groups.some(F.col("failed_wide") & F.col("kind").isin(WIDE_KINDS)).alias("config"),
        groups.every(F.col("kind") == "inert").alias("all_inert"),
    ).crossJoin(unknown.agg(groups.some(F.col("workspace").isNull()).alias("outside"))).first()
    reason = (
        index_error
        or ("no changed files" if not first["n"] else None)
        or ("build configuration or toolchain changed" if first["config"] else None)
        or ("a change lies outside every workspace" if first["outside"] else None)
    )
    if reason:
        wide = decisions.fail_wide(spaces, reason)
        commands = _command(wide, "workspace_wide", reason, F.array())
        selections = wide.select("workspace", F.lit(True).alias("failed_wide"), "reason")
        return Report(
            {"failed_wide": True, "reason": reason, "strategy": "workspace_wide"}, explained, files, items,
            everything.withColumn("is_directly_affected", F.lit(False)).drop("package_id"), selections, commands,
            spark.createDataFrame([], "package_id string, n_expected long, n_selected long, n_missing long, result string"),
            _chains(index, reached, closure), matches, package_reasons(everything.limit(0), [], reason),
        )

    live = explained.where("kind <> 'inert'").select("path", "kind")
    hit = reached.join(live, "path", "left_semi").groupBy("package_id").agg(F.bool_or("is_direct").alias("is_directly_affected"))
    if provider is not None:
        told = provider.join(everything, ["workspace", "name"]).select("package_id", "is_directly_affected")
        hit = groups.flag_merge(hit.unionByName(told), ["package_id"], "is_directly_affected")
    wide_spaces = durable(unknown.select("workspace").distinct())
    strategy, selected, commands = _select(index, changes, flagged, live, unknown, hit, closure, contents, wide_spaces, everything)
    if matched_tests is not None:
        commands = validate_commands(commands, matched_tests)

    production = flagged.join(live, "path", "left_semi").join(unknown.select("path"), "path", "left_anti").where(
        "owner is not null and not is_test_source and not is_bin_entry"
    )
    seeds = production.select(F.col("owner").alias("seed")).distinct()
    owned = durable(closure.join(seeds, "seed", "left_semi"))
    checked = strategy in ("closure", "test_source_package")
    checks = decisions.self_check(
        owned.where(F.lit(checked)).select(F.col("seed").alias("changed_package"), F.col("node").alias("package_id")),
        selected.select("package_id").unionByName(everything.join(wide_spaces, "workspace", "left_semi").select("package_id")),
        ["changed_package"], ["package_id"],
    )
    checks = durable(checks)
    if checked and not checks.where("n_missing > 0").isEmpty():
        lost = owned.select(F.col("node").alias("package_id")).distinct().join(selected.select("package_id"), "package_id", "left_anti")
        more = lost.join(everything, "package_id").select("workspace").distinct()
        wide_spaces = durable(wide_spaces.unionByName(more).distinct())
        commands = package_commands(selected.join(everything, "package_id"), wide_spaces, "self-check widened the selection")
    packages = selected.join(everything, "package_id").select("workspace", "name", "is_directly_affected")
    where = packages.select("workspace").unionByName(wide_spaces).distinct()
    selections = joins.validated_lookup(where, wide_spaces.distinct(), ["workspace"]).select(
        "workspace", F.col("is_known").alias("failed_wide"),
        F.when(F.col("is_known"), "workspace could not be narrowed").otherwise(strategy).alias("reason"),
    )
    if provider is not None:
        unreported = durable(unreported_workspaces(packages, provider if reported is None else reported))
        selections = mark_unreported(selections, unreported)
        commands = groups.replace_partition(commands, unreported, "workspace", _command(unreported, "workspace_wide", UNREPORTED, F.array()))
    n = selections.agg(groups.every(F.col("failed_wide")).alias("w"), F.count("*").alias("n")).first()
    summary = {"failed_wide": bool(n["w"] and n["n"]), "reason": None, "strategy": strategy}
    paths_known = sorted(r["path"] for r in flagged.join(live, "path", "left_semi").join(unknown.select("path"), "path", "left_anti").select("path").collect())
    reasons = package_reasons(packages, paths_known, strategy)
    return Report(summary, explained, files, items, packages, selections, commands, checks, _chains(index, reached, closure), matches, reasons)


#: Why a workspace is run whole though its packages are known.
UNREPORTED = "the provider did not report the workspace of a selected package"


def unreported_workspaces(packages: DataFrame, provider: DataFrame) -> DataFrame:
    """(workspace) of selected packages that ``provider(workspace, ...)`` has no row for."""
    return packages.select("workspace").distinct().join(provider.select("workspace"), "workspace", "left_anti")


def mark_unreported(selections: DataFrame, unreported: DataFrame) -> DataFrame:
    """``selections(workspace, failed_wide, reason)`` with the unreported ones wide."""
    marked = joins.validated_lookup(selections, unreported, ["workspace"])
    return marked.select(
        "workspace", (F.col("failed_wide") | F.col("is_known")).alias("failed_wide"),
        F.when(F.col("is_known"), UNREPORTED).otherwise(F.col("reason")).alias("reason"),
    )


def package_reasons(packages: DataFrame, changed_files: list[str], reason: str) -> DataFrame:
    """(workspace, name, reason, changed_files) of every selected package: the selection's
    reason and the known changed files."""
    files = F.lit(changed_files).cast("array<string>")
    return packages.select("workspace", "name", F.lit(reason).alias("reason"), files.alias("changed_files"))


def _chains(index: Index, reached: DataFrame, closure: DataFrame) -> DataFrame:
    """(seed, src, dst, relationship) of dependency edges inside each direct package's closure."""
    seeds = reached.where("is_direct").select(F.col("package_id").alias("seed")).distinct()
    edges = index["package_dependencies"].select(F.col("package_id").alias("src"), F.col("depends_on_package_id").alias("dst"), "kind")
    inner = graph.induced_edges(edges.select("src", "dst"), closure.join(seeds, "seed", "left_semi"))
    return inner.join(edges, ["src", "dst"]).select(
        "seed", "src", "dst", F.concat(F.lit("reverse Cargo "), "kind", F.lit(" dependency")).alias("relationship")
    ).distinct()


def _snapshot_status(index: Index, base: Index | None, changes: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    keyed = lambda ix: ix["items"].join(ix["files"].select("file_id", "path"), "file_id").join(
        changes.select("path"), "path", "left_semi"
    )
    if base is None:
        hashes = index["files"].select("path", "hash")
        known = flagged.where("is_build").select("path")
        rows = changes.select("path").join(hashes, "path", "left").join(known.withColumn("_k", F.lit(True)), "path", "left")
        files = rows.select("path", F.lit("unknown").alias("status"), (F.col("hash").isNull() & F.col("_k").isNull()).alias("is_unknown"))
        return durable(files), index.spark.createDataFrame([], "path string, kind string, name string, status string")
    items = durable(diff.keyed_diff(keyed(base), keyed(index), ["path", "kind", "name"], "item_id", ["visibility", "span"]))
    before = test_sources(base, owners(base, changes)).where("is_build").select("path")
    known = flagged.where("is_build").select("path").unionByName(before)
    return durable(diff.file_diff(changes, base["files"], index["files"], items, known)), items


def _select(index, changes, flagged, live, unknown, hit, closure, contents, wide_spaces, everything):
    """Strategy, selected packages (package_id, is_directly_affected) and commands."""
    known = flagged.join(live, "path").join(unknown.select("path"), "path", "left_anti")
    included = index["source_dependencies"].select(F.col("target_path").alias("path")).distinct().withColumn("_inc", F.lit(True))
    hits = module_hits(index, changes)
    manifests = manifest_changes(changes, contents).select("path", F.col("is_inert").alias("_quiet"))
    known = durable(known.join(included, "path", "left").join(hits, "path", "left").join(manifests, "path", "left"))
    c = F.col
    production = c("owner").isNotNull() & ~c("is_test_source") & ~c("is_bin_entry")
    is_included = c("_inc").isNotNull()
    build_script = F.endswith("path", F.lit("build.rs"))
    propagates = build_script | (F.endswith("path", F.lit("Cargo.toml")) & ~F.coalesce("_quiet", F.lit(False)))
    flags = known.agg(
        F.count("*").alias("n"),
        groups.some(c("kind") == "configured_repository_input").alias("rule"),
        groups.every(F.coalesce("all_inside", F.lit(False)) & c("owner").isNotNull() & c("is_src")).alias("modules"),
        groups.some(c("is_test_target")).alias("a_target"),
        groups.every(c("is_test_source")).alias("all_tests"),
        groups.some(production).alias("production"),
        groups.some(is_included).alias("included"),
        groups.every(c("is_build") & ~F.endswith("path", F.lit("Cargo.lock"))).alias("metadata"),
        groups.some(propagates).alias("propagates"),
        groups.every(c("is_bin_entry")).alias("bins"),
    ).first()
    names = index["packages"].select(F.col("id").alias("owner"), "workspace", "name")
    own = known.where("owner is not null").select(F.col("owner").alias("package_id"), F.lit(True).alias("is_directly_affected")).distinct()
    local = lambda reason: package_commands(own.join(everything, "package_id"), wide_spaces, reason)
    if flags["n"] and not flags["rule"]:
        if flags["modules"]:
            rows = known.join(names, "owner").select("workspace", "name", "path", "relative", F.explode("modules").alias("module"))
            rows = rows.withColumn("filter", paths.module_filter(c("relative"), c("module")))
            # commands are counted after files that need the same one are merged
            grouped = durable(rows.groupBy("workspace", "name", "filter").agg(groups.collect_sorted(c("path")).alias("files")))
            if decisions.capped(grouped, F.struct("workspace", "name")).first()["over_cap"]:
                return "package", own, local("more module filters than a package is worth")
            args = F.array(F.lit("-p"), c("name"), c("filter"))
            return "module", own, _command(grouped, "module", "changes lie in test modules", args, c("filter"), c("files"))
        if flags["a_target"] and flags["all_tests"] and not flags["included"]:
            targets = index["targets"].where(F.array_contains("kind", "test")).select(
                F.col("src_path").alias("path"), F.col("package_id").alias("owner"), F.col("name").alias("target")
            )
            rows = known.select("path", "owner").join(targets, ["path", "owner"]).join(names, "owner")
            args = F.array(F.lit("-p"), c("name"), F.lit("--test"), c("target"))
            return "test_target", own, _command(rows, "test_target", "changes lie in test targets", args, files=F.array("path"))
        if flags["all_tests"] and not flags["production"] and not flags["included"]:
            return "test_source_package", own, local("changes lie in test sources")
        if flags["metadata"] and not flags["propagates"] and not flags["included"]:
            return "package_metadata", own, local("changes lie in package metadata")
        if flags["bins"] and not flags["included"]:
            return "bin_entry", own, local("changes lie in binary entry points")
    tests = known.where("owner is not null").groupBy("owner").agg(groups.every(c("is_test_source") & ~is_included).alias("only")).where("only")
    tests = tests.select(F.col("owner").alias("seed"))
    others = hit.where("is_directly_affected").select(F.col("package_id").alias("seed")).join(tests, "seed", "left_anti")
    by_others = closure.join(others.distinct(), "seed", "left_semi").select("node")
    drop = closure.join(tests, "seed", "left_semi").where("seed <> node").select("node").distinct()
    drop = drop.join(by_others, "node", "left_anti").join(tests, F.col("node") == tests["seed"], "left_anti")
    selected = durable(hit.join(drop.select(F.col("node").alias("package_id")), "package_id", "left_anti"))
    return "closure", selected, package_commands(selected.join(everything, "package_id"), wide_spaces, "reverse dependency closure")


def validate_commands(commands: DataFrame, matched: DataFrame) -> DataFrame:
    """Module commands without a matching test in ``matched(workspace, args, test)`` run their
    package instead, or the workspace where no package is named."""
    package = F.get("args", F.array_position("args", F.lit("-p")).cast("int"))
    found = matched.groupBy("workspace", "args").agg(groups.collect_sorted(F.col("test")).alias("_tests"))
    keyed = commands.withColumns({"package": package, "_old": F.col("mode")})
    out = decisions.widen_unmatched(keyed, matched.select("workspace", "args"), ["workspace", "args"]).join(found, ["workspace", "args"], "left")
    changed = F.col("mode") != F.col("_old")
    none = F.array().cast("array<string>")
    args = F.when(~changed, F.col("args")).when(F.col("mode") == "package", F.array(F.lit("-p"), F.col("package"))).otherwise(none)
    reason = F.when(F.col("mode") == "package", "the module filter matched no tests").otherwise("the module filter could not be validated")
    return out.select(
        "workspace", "mode", args.alias("args"), F.when(~changed, F.col("module_filter")).alias("module_filter"),
        F.when(changed, F.col("_old")).alias("widened_from"), F.coalesce("_tests", none).alias("matched_tests"),
        F.when(changed, reason).otherwise(F.col("reason")).alias("reason"), "changed_files",
    )
