"""Schemas of the index tables and of a query's inputs."""

from __future__ import annotations

INDEX_VERSION = 1
META = "version int, tool_version string, root string, head string, file_list_hash string, tracked_list_hash string, package_hash string, generated_at_ms long"
FILES = "file_id string, path string, hash string, byte_len long"
ITEMS = (
    "item_id string, file_id string, kind string, name string, visibility string, "
    "span struct<start_line int, start_column int, end_line int, end_column int>, parent_item_id string, is_test boolean"
)
PACKAGES = "id string, name string, workspace string, workspace_path string, manifest_path string, root_path string"
TARGETS = "id string, package_id string, name string, kind array<string>, test boolean, src_path string"
PACKAGE_DEPENDENCIES = "package_id string, depends_on_package_id string, name string, depends_on_path string, kind string, target string"
MODULE_DECLARATIONS = "file_id string, from_item_id string, target_paths array<string>"
SOURCE_DEPENDENCIES = "source_path string, target_path string, kind string"
EDGES = "`from` string, `to` string, kind string"
TABLES = {
    "meta": META,
    "files": FILES,
    "items": ITEMS,
    "packages": PACKAGES,
    "targets": TARGETS,
    "package_dependencies": PACKAGE_DEPENDENCIES,
    "module_declarations": MODULE_DECLARATIONS,
    "source_dependencies": SOURCE_DEPENDENCIES,
    "edges": EDGES,
}
CHANGES = "path string, ranges array<struct<start_line int, end_line int>>"
RULES = "rule_index int, source string, selection string, regex string, workspaces array<string>, packages array<string>"
COMMANDS = (
    "workspace string, mode string, args array<string>, module_filter string, widened_from string, "
    "matched_tests array<string>, reason string, changed_files array<string>"
)

# Item kinds.
ITEM_KINDS = [
    "Const", "Enum", "Fn", "ForeignMod", "Impl", "Macro", "Mod", "Static", "Struct", "Trait", "TraitAlias", "TypeAlias",
    "Union", "Use", "AssocItem",
]
