"""What Python workers keep in memory between tasks.

Spark hands the same worker processes from one operator to the next.  What an operator
remembers across tasks (words it has encoded, say) is of use to its own tasks alone, so the
first task of another operator in a process makes the rest forget, and gives the memory back
to the system: a long pipeline then weighs what its heaviest stage weighs, not their sum.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_FORGET: dict[str, Callable[[], None]] = {}
_NOW: list[str] = []


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Tell, when a module is imported, how to empty what its operator remembers."""
    _FORGET[operator] = forget


def begin(operator: str) -> None:
    """Called by each task before it works for ``operator``."""
    if _NOW != [operator]:
        for name, forget in _FORGET.items():
            if name != operator:
                forget()
        _NOW[:] = [operator]
        release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
