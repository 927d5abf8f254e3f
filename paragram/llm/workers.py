"""Memory of Python workers, which Spark reuses from task to task and from operator to operator.

A worker holds one tool (a tokenizer with its cache of chunks) at a time: a task that needs another, or none, begins by
dropping it.  At a task's end what was freed goes back to the system, so that a worker's size is that of its largest
task and not of all that it ever ran.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

_TOOL: dict[Hashable, object] = {}


def tool(key: Hashable, make: Callable[[], object]) -> object:
    """The worker's tool under `key`, made where it holds another or none."""
    if key not in _TOOL:
        _TOOL.clear()
        _TOOL[key] = make()
    return _TOOL[key]


def held() -> list[Hashable]:
    """The key of the worker's tool, if it has one."""
    return list(_TOOL)


def give_back() -> None:
    """Freed memory goes back to the system (where the C library can do that)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def drop_others(key: Hashable) -> None:
    """Drops the worker's tool, if it isn't the one under `key`."""
    if _TOOL and key not in _TOOL:
        _TOOL.clear()
        give_back()


def task(function: Callable[[Iterator], Iterator], needs: Hashable = None) -> Callable[[Iterator], Iterator]:
    """function, for mapInArrow, as a task that drops any tool but the one it needs and gives memory back at its end.

    What it returns is sent to workers by value, so it reaches the worker's own state by functions of this module only.
    """

    def run(batches):
        drop_others(needs)
        try:
            yield from function(batches)
        finally:
            give_back()

    return run
