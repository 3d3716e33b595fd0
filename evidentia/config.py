"""Settings from the environment."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

PREFIX = "EVIDENTIA_"


def setting(env: Mapping[str, str], *names: str) -> str | None:
    """The first of the variables that isn't blank, trimmed."""
    return next((v for n in names if (v := (env.get(n) or "").strip())), None)


def number(env: Mapping[str, str], default: float, *names: str) -> float:
    """A finite number of 0 or more; anything else is the default, so that a
    slip can't switch a limit off."""
    try:
        x = float(setting(env, *names) or "")
    except ValueError:
        return default
    return x if math.isfinite(x) and x >= 0 else default


@dataclass(frozen=True)
class Settings:
    root: str
    concurrency: int = 2
    retries: int = 3
    approval_threshold: int = 25

    @classmethod
    def from_env(cls, env: Mapping[str, str], older: str | None = None) -> "Settings":
        """Variables EVIDENTIA_ROOT, _CONCURRENCY, _RETRIES and
        _APPROVAL_THRESHOLD; ``older`` is a prefix that is tried after it."""
        names = lambda x: [p + x for p in (PREFIX, older) if p]
        root = setting(env, *names("ROOT"))
        if root is None:
            raise ValueError(f"{PREFIX}ROOT is required")
        return cls(root, *(int(number(env, d, *names(x))) for x, d in (("CONCURRENCY", 2), ("RETRIES", 3), ("APPROVAL_THRESHOLD", 25))))
