"""Settings of a repository: defaults, overridden field by field by its loomgraph.json."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace

FILE = "loomgraph.json"


@dataclass(frozen=True)
class EditGuard:
    enabled: bool = True
    min_impacted_files: int = 2
    top_files: int = 5
    top_co_changes: int = 3
    max_symbols_per_file: int = 40
    depth: int = 2


@dataclass(frozen=True)
class Config:
    context_pack_tokens: int = 6000
    max_commits: int = 2000
    ignore: tuple[str, ...] = ()
    workspace_repos: tuple[str, ...] = ()
    edit_guard: EditGuard = field(default_factory=EditGuard)
    gate_min_severity: str = "high"


def _merged(own, given: dict):
    known = {f.name: getattr(own, f.name) for f in fields(own)}
    new = {}
    for name, value in given.items():
        if name not in known or value is None:
            continue
        if is_dataclass(known[name]):
            value = _merged(known[name], value)
        elif isinstance(known[name], tuple):
            value = tuple(value)
        new[name] = value
    return replace(own, **new)


def load(root: str) -> Config:
    """The settings of the repository at root; unknown fields are ignored, a file that is no JSON raises."""
    path = os.path.join(root, FILE)
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        return _merged(Config(), json.load(f))
