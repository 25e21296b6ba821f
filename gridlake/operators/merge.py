"""Rules for values that are not on the concatenated axis: keep what is the same, unique, first or the only one."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

MISSING = object()


def union_keys(maps: list[Mapping]) -> list:
    return list(dict.fromkeys(k for m in maps for k in m))


def shared_keys(maps: list[Mapping]) -> list:
    return [k for k in (maps[0] if maps else {}) if all(k in m for m in maps)]


def equal(a: Any, b: Any) -> bool:
    """Equal values; NaN equals NaN, arrays and frames are compared by shape and value."""
    if hasattr(a, "same_as"):
        return type(a) is type(b) and a.same_as(b)
    if hasattr(a, "equals") or hasattr(b, "equals"):
        return type(a) is type(b) and bool(a.equals(b))
    if hasattr(a, "shape") or hasattr(b, "shape"):
        import numpy as np

        a, b = np.asarray(a), np.asarray(b)
        if a.shape != b.shape:
            return False
        same = (a == b) | ((a != a) & (b != b))
        return bool(np.all(same))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(equal, a, b))
    return bool(a == b) or (a != a and b != b)


def _same(values: list) -> Any:
    there = [v for v in values if v is not MISSING]
    return there[0] if len(there) == len(values) and all(equal(there[0], v) for v in there[1:]) else MISSING


def _unique(values: list) -> Any:
    there = [v for v in values if v is not MISSING]
    return there[0] if there and all(equal(there[0], v) for v in there[1:]) else MISSING


def _first(values: list) -> Any:
    return next((v for v in values if v is not MISSING), MISSING)


def _only(values: list) -> Any:
    there = [v for v in values if v is not MISSING]
    return there[0] if len(there) == 1 else MISSING


RULES: dict[str, Callable[[list], Any]] = {"same": _same, "unique": _unique, "first": _first, "only": _only}


def merge_maps(maps: list[Mapping], rule: str | Callable | None) -> dict:
    """Merge nested mappings key by key. Keys that are mappings wherever they occur are merged inside; what merges
    to nothing vanishes. A callable gets the list of mappings and returns the merged one."""
    if rule is None:
        return {}
    if callable(rule):
        return dict(rule(maps))
    if rule not in RULES:
        raise ValueError(f"no merge rule {rule!r}; there are {sorted(RULES)}")
    out = {}
    for k in union_keys(maps):
        values = [m.get(k, MISSING) for m in maps]
        there = [v for v in values if v is not MISSING]
        if all(isinstance(v, Mapping) for v in there):
            inner = merge_maps([v if v is not MISSING else {} for v in values], rule)
            if inner:
                out[k] = inner
        else:
            v = RULES[rule](values)
            if v is not MISSING:
                out[k] = v
    return out


def merge_outer(maps: list[Mapping], batches: list[str]) -> dict:
    """Everything is kept; what differs gets its batch as a suffix."""
    out = {}
    for k in union_keys(maps):
        v = _unique([m.get(k, MISSING) for m in maps])
        if v is not MISSING:
            out[k] = v
        else:
            out |= {f"{k}-{b}": m[k] for m, b in zip(maps, batches) if k in m}
    return out
