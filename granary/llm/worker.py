"""What a Python worker keeps from task to task.

Workers live on from stage to stage, and so do the tables of words that some operators fill. An operator that starts in a worker
empties what others have left there and gives the memory back, so tables of different operators never add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_left: dict[str, Callable[[], None]] = {}


def enter(operator: str) -> None:
    """Called where an operator's function begins in a worker."""
    others = [k for k in _left if k != operator]
    for k in others:
        _left.pop(k)()
    if others:
        tidy()


def keeps(operator: str, clear: Callable[[], None]) -> None:
    """Tell how to empty an operator's tables."""
    _left[operator] = clear


def tidy() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
