"""Driver-side configuration: overrides, section digests, profile choice and exit codes."""

from __future__ import annotations

import copy
import hashlib
import json

# Exit codes by outcome.
EXIT_CODES = {"ok": 0, "failed": 1, "usage": 2, "invalid_output": 3}


def override(config: dict, change: str) -> dict:
    """A copy of ``config`` with one ``dotted.path=value`` applied.

    The value takes the type of what is there: booleans are ``true`` or ``false``, lists are JSON,
    ``null`` is for text and empty leaves only.  An unknown path, a section or a value of another
    type raises ``ValueError``.
    """
    path, sign, value = change.partition("=")
    out = copy.deepcopy(config)
    *sections, leaf = path.strip().split(".")
    at = out
    for name in sections:
        at = at.get(name) if isinstance(at, dict) else None
    if not sign or not isinstance(at, dict) or leaf not in at or isinstance(at[leaf], dict):
        raise ValueError(f"no such setting: {path.strip()}")
    at[leaf] = _coerced(at[leaf], value.strip(), path)
    return out


def _coerced(old, value: str, path: str):
    if value == "null":
        if old is None or isinstance(old, str):
            return None
        raise ValueError(f"{path} cannot be null")
    if isinstance(old, bool):
        if value not in ("true", "false"):
            raise ValueError(f"{path} is true or false, not {value!r}")
        return value == "true"
    if isinstance(old, list):
        new = json.loads(value)
        if not isinstance(new, list):
            raise ValueError(f"{path} is a list, not {value!r}")
        return new
    return type(old)(value) if isinstance(old, (int, float)) else value


def digest(config: dict, sections: list[str]) -> str:
    """SHA-256 of the canonical JSON of the sections that a stage reads."""
    own = {name: config[name] for name in sorted(sections)}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def profile(width: int, height: int, rotation: int = 0) -> str:
    """``short`` for an upright picture, else ``long``."""
    wide, high = (height, width) if rotation % 180 == 90 else (width, height)
    return "short" if high > wide else "long"
