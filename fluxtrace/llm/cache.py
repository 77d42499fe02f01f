"""A look-up table that is filled as keys come, bounded by bytes and emptied when a task ends."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any, TypeVar


class Generations(dict):
    """Keys to what ``make`` gives for them.

    At about half of ``most`` bytes the entries become the older generation, from which those
    still in use come back, and the one before goes.  This changes nothing but the time.
    """

    #: Bytes of an entry beyond its key's and value's contents.
    ENTRY = 140

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.held = most, 0
        self.older: dict = {}

    def make(self, key: Any) -> Any:
        raise KeyError(key)

    def forget(self) -> None:
        self.clear()
        self.older.clear()
        self.held = 0

    def keep(self, key: Hashable, value: Any) -> None:
        """Remembers an entry, unless it is larger than a generation."""
        size = self.ENTRY + 4 * len(key) + (len(value) if isinstance(value, bytes) else 0)
        if size > self.most // 2:
            return
        if self.held + size > self.most // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value

    def keep_all(self, entries: dict) -> None:
        """Remembers entries whose values are bytes; at once if the generation has room for them all."""
        size = self.ENTRY * len(entries) + 4 * sum(map(len, entries)) + sum(map(len, entries.values()))
        if self.held + size > self.most // 2:
            for key, value in entries.items():
                self.keep(key, value)
        else:
            self.held += size
            self.update(entries)

    def recall_all(self, keys: Iterable[Hashable]) -> dict:
        """The entries of keys that only the older generation may hold; these come back."""
        older = self.older
        found = {key: value for key in keys if (value := older.get(key)) is not None}
        self.keep_all(found)
        return found

    def recall(self, key: Hashable) -> Any:
        """An entry, or None."""
        value = self.get(key)
        if value is None and (value := self.older.get(key)) is not None:
            self.keep(key, value)
        return value

    def __missing__(self, key: Hashable) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value


T = TypeVar("T")


@contextmanager
def borrowed(owner: T, *caches: Generations) -> Iterator[T]:
    """The owner of some caches for a task; they are emptied at its end, so that idle workers don't hold them."""
    try:
        yield owner
    finally:
        for cache in caches:
            cache.forget()
