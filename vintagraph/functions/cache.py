"""A small cache of results on the driver: entries expire, the least used and oldest goes first."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable
from typing import Any


class Cache:
    """At most ``size`` entries for ``ttl`` seconds since their last use; of a full cache the least often used entry goes,
    of those the one unused for longest."""

    def __init__(self, size: int = 100, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock, self._held = size, ttl, clock, {}

    def get(self, key: Hashable) -> Any | None:
        e = self._held.get(key)
        if e is None:
            return None
        now = self.clock()
        if now - e[2] > self.ttl:
            del self._held[key]
            return None
        self._held[key] = (e[0], e[1] + 1, now)
        return e[0]

    def put(self, key: Hashable, value: Any) -> None:
        if key not in self._held and len(self._held) >= self.size:
            del self._held[min(self._held, key=lambda k: self._held[k][1:])]
        self._held[key] = (value, 0, self.clock())

    def __len__(self) -> int:
        return len(self._held)
