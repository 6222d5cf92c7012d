"""What a Python worker remembers between batches: one store of words, bounded in bytes.

Spark reuses Python workers, so whatever a module keeps outlives the stage that filled it. All
operators therefore share this one place: a worker holds the store of one owner at a time, the
store of the owner before it is dropped, and a store that has passed LIMIT bytes is emptied.
Results never depend on what is remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of a store, by estimate, and what a word takes beside its characters and its value.
LIMIT, PER_WORD = 40_000_000, 150


class WordStore:
    """``words`` and their values. ``learn`` adds some, ``room`` empties a full store between batches.

    ``words`` is a plain dict: set operations look words up in one, but walk through all of a subclass.
    """

    def __init__(self, limit: int = LIMIT, per_word: int = PER_WORD):
        self.words: dict[Any, Any] = {}
        self.limit, self.per_word, self.size = limit, per_word, 0

    def learn(self, values: Mapping[Any, Any]) -> None:
        self.words.update(values)
        self.size += sum(map(len, values)) + self.per_word * len(values)

    def room(self) -> bool:
        """Whether the store was emptied because it was full."""
        if self.size <= self.limit:
            return False
        self.words.clear()
        self.size = 0
        return True


_HELD: dict[tuple, Any] = {}


def held(owner: tuple, make: Callable[[], Any]) -> Any:
    """The worker's store of ``owner``; any other owner's store is dropped first."""
    if owner not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[owner] = make()
    return _HELD[owner]


def release() -> None:
    """Drop whatever the worker holds; called by stages that keep nothing."""
    if _HELD:
        _HELD.clear()
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, most: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``most`` bytes of ``column`` (or one row) and ``rows`` rows."""
    values, begin, size = batch.column(column), 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > begin and (size + n > most or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if batch.num_rows > begin:
        yield batch.slice(begin)
