"""The rule file: TOML with ``[[rules]]`` and ``[[build-script-inputs]]``."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..functions.classes import CONFIG_FILE
from ..functions.globs import any_glob

SELECTIONS = ["workspace", "packages", "ignore"]


@dataclass
class Config:
    rules: list[tuple] = field(default_factory=list)
    default_inert_paths: bool = True

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rules, schemas.RULES)


def _texts(entry: dict, key: str, where: str) -> list[str]:
    value = entry.get(key, [])
    if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
        raise ValueError(f"{where}: {key} must be a list of texts")
    return value


def parse(text: str) -> Config:
    """Rules in order; an unknown field, an empty path list, a bad glob or a selection
    without what it needs is an error."""
    data = tomllib.loads(text)
    unknown = set(data) - {"rules", "build-script-inputs", "default-inert-paths"}
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    out = Config(default_inert_paths=bool(data.get("default-inert-paths", True)))
    for kind, key, allowed in (
        ("rule", "rules", {"paths", "selection", "workspaces", "packages"}),
        ("build_script_input", "build-script-inputs", {"paths", "packages"}),
    ):
        for i, entry in enumerate(data.get(key, [])):
            where = f"{kind} {i + 1}"
            if set(entry) - allowed:
                raise ValueError(f"{where}: unknown fields: {', '.join(sorted(set(entry) - allowed))}")
            paths = _texts(entry, "paths", where)
            if not paths:
                raise ValueError(f"{where}: paths must not be empty")
            selection = entry.get("selection") if kind == "rule" else "packages"
            if selection not in SELECTIONS:
                raise ValueError(f"{where}: selection must be one of {', '.join(SELECTIONS)}")
            workspaces, packages = _texts(entry, "workspaces", where), _texts(entry, "packages", where)
            if selection == "workspace" and not workspaces or selection == "packages" and not packages:
                raise ValueError(f"{where}: {selection} selects nothing")
            if selection == "ignore" and (workspaces or packages):
                raise ValueError(f"{where}: ignore selects nothing")
            out.rules.append((i, kind, selection, any_glob(paths), workspaces, packages))
    return out


def load_optional(root: str) -> Config:
    path = Path(root) / CONFIG_FILE
    return parse(path.read_text()) if path.exists() else Config()
