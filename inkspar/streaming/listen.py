"""Listeners: progress of running ingests, and new editions of an index."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener

from ..sources.store import Registry, StoredIndex


class Progress(StreamingQueryListener):
    """Keeps the last events of the queries that run: register it with spark.streams.addListener."""

    def __init__(self, size: int = 1000, on_event: Callable[[dict], None] | None = None):
        self.events: deque[dict] = deque(maxlen=size)
        self.on_event = on_event

    def _add(self, event: dict) -> None:
        self.events.append(event)
        if self.on_event:
            self.on_event(event)

    def onQueryStarted(self, event) -> None:
        self._add({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self._add({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self._add({"event": "terminated", "id": str(event.id), "error": event.exception})


@dataclass
class Subscription:
    """Tells of editions that are newer than the last one told: of one index, and keeps its entry in a registry up to date."""

    index: StoredIndex
    callback: Callable[[int], None]
    seen: int = -1
    registry: Registry | None = None
    alias: str | None = None
    told: list[int] = field(default_factory=list)

    def poll(self) -> bool:
        """Look once; true if there was a new edition.  Editions between are passed over."""
        latest = self.index.latest()
        if latest <= self.seen:
            return False
        self.seen = latest
        self.told.append(latest)
        if self.registry and self.alias:
            self.registry.add(self.alias, self.index.path, latest)
        self.callback(latest)
        return True
