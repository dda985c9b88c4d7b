"""What a Python worker remembers from one batch to the next: one cache at a time, of bounded size.

Workers outlive stages, so a cache that an earlier stage filled would stay beside the next one's. A task that uses a cache
names it first, and all others are emptied.
"""

from __future__ import annotations

from collections.abc import Callable

_EMPTY: dict[str, Callable[[], None]] = {}


def register(name: str, empty: Callable[[], None]) -> None:
    _EMPTY[name] = empty


def only(name: str) -> None:
    """Empties all caches but the named one."""
    for other, empty in _EMPTY.items():
        if other != name:
            empty()
