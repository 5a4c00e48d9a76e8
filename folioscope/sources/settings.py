"""Settings in layers: defaults, machine, workspace, environment, call. Later layers win; lists of kept things add up."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

ADDED = ("preserve", "protected_forms")


def overlay(layers: list[tuple[str, Mapping[str, Any]]]) -> tuple[dict[str, Any], dict[str, str]]:
    """(settings, origin): the merged settings, and for each leaf, by its dotted name, the layer it comes from."""
    out: dict[str, Any] = {}
    origin: dict[str, str] = {}

    def put(into: dict[str, Any], values: Mapping[str, Any], name: str, path: str) -> None:
        for k, v in values.items():
            at = f"{path}.{k}" if path else k
            if v is None:
                continue
            if isinstance(v, Mapping):
                put(into.setdefault(k, {}), v, name, at)
            elif k in ADDED and isinstance(into.get(k), list):
                into[k] = list(dict.fromkeys([*into[k], *v]))
                origin[at] = f"{origin[at]}+{name}"
            else:
                into[k] = list(v) if isinstance(v, (list, tuple)) else v
                origin[at] = name

    for name, values in layers:
        put(out, values, name, "")
    return out, origin


def from_environment(env: Mapping[str, str], prefix: str = "FOLIOSCOPE_") -> dict[str, Any]:
    """Settings named in the environment: a double underscore goes one level down."""
    out: dict[str, Any] = {}
    for k, v in env.items():
        if k.startswith(prefix):
            at = out
            *path, last = k[len(prefix) :].lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = v
    return out
