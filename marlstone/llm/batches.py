"""Plain-Python pieces for functions that run on Arrow batches."""

from __future__ import annotations

import ctypes
import itertools
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa

_BLANKS = frozenset(b" \t\n\x0b\f\r")


def word_lists(data: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists of about ``step`` bytes, each word whole and in order."""
    at, size = 0, len(data)
    if size <= step:
        yield data.split()
        return
    while at < size:
        end = min(at + step, size)
        while end < size and data[end] not in _BLANKS:
            end += 1
        yield data[at:end].split()
        at = end


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, shared by all tasks that run in it."""
    return sys.modules.setdefault("_marlstone_worker_cache", types.ModuleType("_marlstone_worker_cache")).__dict__.setdefault("held", {})


def held(key: tuple, make: Callable):
    """``make()`` once for each worker and ``key``."""
    cache = worker_cache()
    if key not in cache:
        cache[key] = make()
    return cache[key]


def tidy(run: Callable) -> Callable:
    """``run`` over batches that gives freed memory back to the system at a task's end.

    A worker waits for its next task beside a JVM that may need the room meanwhile.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return tidied


class Memo(dict):
    """Answers of ``make``, at most ``limit`` of them.

    A key is kept from its second request on: a bitmap of hashed keys tells repeated requests from
    first ones, so the many keys that never come back take no room.  A full memo stays as it is, as the
    keys that came back first are the frequent ones, but lets half go after ``10 * limit`` refusals.
    """

    def __init__(self, make: Callable | None, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.refused, self.asked = make, limit, 0, bytearray(1 << 21)

    def keep(self, key, value) -> None:
        h = hash(key)
        at, bit = (h >> 3) & 0x1FFFFF, 1 << (h & 7)
        if not self.asked[at] & bit:
            self.asked[at] |= bit
        elif len(self) < self.limit:
            self[key] = value
        else:
            self.refused += 1
            if self.refused > 10 * self.limit:
                self.refused = 0
                for k in list(itertools.islice(self, self.limit // 2)):
                    del self[k]

    def __missing__(self, key):
        value = self.make(key)
        self.keep(key, value)
        return value
