"""Memory of Python workers, which outlive stages: only one operator's caches stay at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_clear: dict[str, Callable[[], object]] = {}
_owner = ""


def register(owner: str, clear: Callable[[], object]) -> None:
    """Names the function that empties an owner's caches."""
    _clear[owner] = clear


def claim(owner: str) -> None:
    """Empties the caches of all other owners, and returns what that frees to the system."""
    global _owner
    if owner == _owner:
        return
    for name, clear in _clear.items():
        if name != owner:
            clear()
    _owner = owner
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
