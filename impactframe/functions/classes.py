"""Path classes: build inputs, inert files and generated files, as ordered CASE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, extension

# Names and extensions that decide a path's class.
METADATA_DIRECTORIES = [".agents", ".claude", ".cursor", ".devcontainer", ".github", ".idea", ".vscode"]
METADATA_FILE_PREFIXES = [
    "authors", "changelog", "changes", "codeowners", "contributors", "contributing", "copying", "license",
    "licence", "notice", "security",
]
CONFIG_FILE = ".impactframe.toml"
METADATA_FILE_NAMES = [CONFIG_FILE, "codeowners"]
INERT_EXTENSIONS = [
    "adoc", "avif", "gif", "ico", "jpeg", "jpg", "md", "mdx", "mov", "mp3", "mp4", "otf", "pdf", "png", "rst",
    "svg", "ttf", "wav", "webp", "woff", "woff2",
]
METADATA_FILE_EXTENSIONS = ["adoc", "md", "rst", "txt"]
SCRIPT_EXTENSIONS = ["cjs", "cts", "js", "jsx", "mjs", "mts", "ts", "tsx"]
INERT_MANIFEST_KEYS = [
    "authors", "categories", "description", "documentation", "homepage", "keywords", "license", "license-file",
    "publish", "readme", "repository", "rust-version",
]
# Raw suffixes of build inputs, in order of test, with their kinds.
BUILD_SUFFIXES = [("Cargo.toml", "manifest"), ("Cargo.lock", "lockfile"), ("build.rs", "build_script")]
BUILD_FILES = [
    (".cargo/config", "cargo_config"),
    (".cargo/config.toml", "cargo_config"),
    ("rust-toolchain", "toolchain"),
    ("rust-toolchain.toml", "toolchain"),
]


def suffix_class(path: Column, suffixes: list[tuple[str, str]], files: list[tuple[str, str]]) -> Column:
    """First of the raw suffixes, then of the whole files (alone or under a directory)."""
    kind = None
    for text, name in suffixes:
        test = F.endswith(path, F.lit(text))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    for text, name in files:
        test = (path == text) | F.endswith(path, F.lit("/" + text))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind


def build_input_kind(path: Column) -> Column:
    return suffix_class(path, BUILD_SUFFIXES, BUILD_FILES)


def inert_class(path: Column) -> Column:
    """Why a file cannot be an input of a build or test; null if it can."""
    lower = F.lower(basename(path))
    ext = extension(path)
    inside = F.arrays_overlap(F.split(path, "/"), F.lit(METADATA_DIRECTORIES))
    recipe = (
        (lower == "dockerfile")
        | F.startswith(lower, F.lit("dockerfile."))
        | (lower == ".dockerignore")
        | F.endswith(lower, F.lit(".dockerfile"))
        | lower.rlike(r"^docker-compose.*\.ya?ml$")
    )
    prefixed = lower.rlike("^(" + "|".join(METADATA_FILE_PREFIXES) + ")") & (
        ext.isNull() | ext.isin(METADATA_FILE_EXTENSIONS)
    )
    return (
        F.when(inside, "metadata_directory")
        .when(recipe, "container_recipe")
        .when(lower.isin(METADATA_FILE_NAMES), "metadata_file")
        .when(ext.isin(INERT_EXTENSIONS), "document_or_media")
        .when(ext.isin(SCRIPT_EXTENSIONS), "script_source")
        .when(prefixed, "legal_or_community")
    )


def is_generated(path: Column) -> Column:
    """``target`` as a whole or first or inner directory, or an inner ``out`` directory."""
    return (
        (path == "target")
        | F.startswith(path, F.lit("target/"))
        | F.contains(path, F.lit("/target/"))
        | F.contains(path, F.lit("/out/"))
    )
