"""What a Python worker keeps between tasks: the models of the operator that ran last, and of no other."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

_owner: list[str] = []
_kept: dict = {}


def held(operator: str, key: Hashable, build: Callable):
    """build() once for each key while the operator stays the same; another operator's models are let go first."""
    if _owner != [operator]:
        _kept.clear()
        tidy()
        _owner[:] = [operator]
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def tidy() -> None:
    """Give free memory back to the system: workers live on, and what the allocators hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that tidies up after its task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return wrapped


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
