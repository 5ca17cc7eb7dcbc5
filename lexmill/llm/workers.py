"""Memory of Python workers: caches that outlive a task, and what goes back to the system."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

# A worker's cache is emptied when it holds this many strings; longer strings are never cached.
CACHE_ENTRIES = 800_000
CACHE_LENGTH = 64


class Cache(dict):
    """Memo of a pure function of short strings, bounded in entries and key length."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


_held: dict = {}


def held(key, make=lambda: None):
    """What ``make`` returns, kept for the next tasks of this worker until another key is asked for.

    A worker serves one operator after another; only the present one's cache is
    in memory, and what the last one used goes back to the system.
    """
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Give free memory back: a worker stays idle while the JVM works on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)
