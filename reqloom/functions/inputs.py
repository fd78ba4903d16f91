"""Checks of what users pass in: thresholds, lists of roles, and maps from stereotypes to roles and relations."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterable, Mapping

from reqloom.functions.vocab import ROLES

#: Values of a flat map that are roles; all others are relation verbs.
_ROLE_WORDS = {*ROLES, "OPERATOR"}


def threshold(value: object, default: float = 0.6) -> float:
    """A number between 0 and 1: others are clamped with a warning; what is no number (or NaN) gives ``default``."""
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    if x != x:
        return default
    if not 0 <= x <= 1:
        warnings.warn(f"threshold {x:g} is outside of 0 to 1", stacklevel=2)
    return min(1.0, max(0.0, x))


def roles(wanted: str | Iterable[str], known: tuple[str, ...] = ROLES) -> tuple[str, ...]:
    """Roles from a comma-separated text or a list, in any letter case, each once; unknown ones are an error."""
    parts = wanted.split(",") if isinstance(wanted, str) else list(wanted)
    names = dict.fromkeys(p.strip().upper() for p in parts if p and p.strip())
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown roles: {', '.join(unknown)}; known: {', '.join(known)}")
    return tuple(names)


def overrides(source: str | Mapping | None, inline: str = "") -> tuple[dict[str, str], dict[str, str]]:
    """(roles, relations) by stereotype in lower case.

    ``source``: a mapping or the path of a JSON file, either {"roles": {...}, "relations": {...}} or flat, where values
    that are roles go to the first and all others to the second. ``inline``: "Stereotype=ROLE,..." on top of it. Entries
    with a blank name or value, and roles that do not exist, are left out.
    """
    data: object = source or {}
    if isinstance(data, (str, os.PathLike)):
        with open(data, encoding="utf-8") as f:
            data = json.load(f)
    if not isinstance(data, Mapping):
        raise ValueError("a map of stereotypes must be an object")
    by_role: dict = {}
    by_verb: dict = {}
    if "roles" in data or "relations" in data:
        by_role, by_verb = dict(data.get("roles") or {}), dict(data.get("relations") or {})
    else:
        for k, v in data.items():
            (by_role if str(v).strip().upper() in _ROLE_WORDS else by_verb)[k] = v
    by_role |= dict(pair.split("=", 1) for pair in inline.split(",") if "=" in pair)
    clean = lambda m: {str(k).strip().lower(): str(v).strip() for k, v in m.items() if v is not None and str(k).strip() and str(v).strip()}
    named = {k: v.upper() for k, v in clean(by_role).items() if v.upper() in _ROLE_WORDS}
    return named, {k: v.lower() for k, v in clean(by_verb).items()}
