"""Memory of the Python workers that Spark reuses, task after task and operator after operator."""

import ctypes
import functools
import inspect
from collections.abc import Callable

import pyarrow as pa

_drops: dict[str, Callable[[], None]] = {}


def remembered(owner: str, drop: Callable[[], None]) -> None:
    """Names a memory that outlives a task, and what drops it."""
    _drops[owner] = drop


def give_back(keep: str | None = None) -> None:
    """Drops all memories but one, and returns what Arrow and malloc hold unused to the system."""
    for owner, drop in _drops.items():
        if owner != keep:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)         # glibc only
    if trim:
        trim(0)


def frugal(keep: str | None = None):
    """Makes an Arrow function of a task give memory back before and after its work; `keep` names the memory it uses itself."""
    def wrap(work):
        if inspect.isgeneratorfunction(work):
            @functools.wraps(work)
            def run(batches):
                give_back(keep)
                yield from work(batches)
                give_back(keep)
        else:
            @functools.wraps(work)
            def run(table):
                give_back(keep)
                out = work(table)
                give_back(keep)
                return out
        return run
    return wrap
