"""What a Python worker process keeps between tasks: the caches of one operator at a time."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_kept: dict[Hashable, Any] = {}


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """The value of a key, made once; values of other keys are let go."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Let go of everything. Operators without caches call this first, as workers outlive stages."""
    _kept.clear()
