"""Aggregated frames kept for later queries, by user and scope."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Entry:
    frame: DataFrame
    base: list
    born: float


class FrameCache:
    """At most ``size`` frames a user, each for ``ttl`` seconds; a frame leaves its storage when evicted.

    An entry serves any query of its scope that needs no more than its measures; one that needs more
    replaces it by a frame with both queries' measures. Threads may share a cache: one at a time looks up,
    and since frames are lazy, none waits for another's query to run.
    """

    def __init__(self, size: int = 32, ttl: float = 300.0, clock=time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: dict[str, OrderedDict] = {}
        self.hits = self.misses = self.evictions = 0
        self.lock = threading.RLock()

    def _drop(self, own: OrderedDict, key) -> None:
        own.pop(key).frame.unpersist()

    def clear(self, user: str | None = None) -> None:
        with self.lock:
            for u in list(self.entries) if user is None else [user]:
                own = self.entries.get(u, OrderedDict())
                for key in list(own):
                    self._drop(own, key)

    def lookup(self, user: str = "", action: str = "USE"):
        """A function for Compiler that gives the frame of a scope, kept or built."""
        if action == "INVALIDATE":
            self.clear(user)
        if action == "NOT_USE":
            return None

        def frames(c, scope, sets, base, build) -> DataFrame:
            with self.lock:
                return found(c, scope, sets, base, build)

        def found(c, scope, sets, base, build) -> DataFrame:
            own = self.entries.setdefault(user, OrderedDict())
            key = (c.query.table, tuple(c.dims), scope, sets, c.catalog.version)
            for old in [k for k, e in own.items() if self.clock() - e.born > self.ttl]:
                self._drop(own, old)
                self.evictions += 1
            entry = own.get(key)
            if entry is not None and all(m in entry.base for m in base):
                self.hits += 1
                own.move_to_end(key)
            else:
                self.misses += 1
                every = list(base) + [m for m in (entry.base if entry else []) if m not in base]
                if entry is not None:
                    self._drop(own, key)
                entry = own[key] = Entry((build() if every == base else c.aggregated(scope, sets, every)).persist(), every, self.clock())
                while len(own) > self.size:
                    self._drop(own, next(iter(own)))
                    self.evictions += 1
            dims = [n for n in entry.frame.columns if n[0] in "dg"]
            return entry.frame.select(*dims, *[F.col(f"m{entry.base.index(m)}").alias(f"m{i}") for i, m in enumerate(base)])

        return frames

    def stats(self) -> dict[str, int]:
        with self.lock:
            return {"hitCount": self.hits, "loadCount": self.misses, "evictionCount": self.evictions, "entries": sum(map(len, self.entries.values()))}

    def histogram(self, edges: tuple[int, ...] = (1, 10, 100, 1000, 10_000)) -> dict[str, int]:
        """How many kept frames have up to so many rows (this counts them)."""
        with self.lock:
            kept = [e.frame for own in self.entries.values() for e in own.values()]
        sizes = [frame.count() for frame in kept]
        out, low = {}, 0
        for edge in edges:
            out[f"({low}, {edge}]"] = sum(low < n <= edge or (low == 0 and n == 0) for n in sizes)
            low = edge
        return out | {f"({low}, inf)": sum(n > low for n in sizes)}
