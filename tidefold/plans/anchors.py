"""Anchors of incremental planning: up to which version a table was compacted, and which files were dealt with."""

from __future__ import annotations

import hashlib
import json
import threading
from dataclasses import dataclass
from typing import Protocol

from tidefold.errors import ConflictError
from tidefold.sources.store import Store


@dataclass(frozen=True)
class Anchor:
    table: str
    version: int
    processed: frozenset[str] = frozenset()


class AnchorStore(Protocol):
    def get(self, table: str) -> Anchor | None: ...
    def put(self, anchor: Anchor) -> None: ...
    def delete(self, table: str) -> None: ...


class MemoryAnchors:
    """Anchors of one driver; an older version never replaces a newer one."""

    def __init__(self) -> None:
        self._lock, self._kept = threading.Lock(), {}

    def get(self, table: str) -> Anchor | None:
        return self._kept.get(table)

    def put(self, anchor: Anchor) -> None:
        with self._lock:
            old = self._kept.get(anchor.table)
            if old is None or old.version <= anchor.version:
                self._kept[anchor.table] = anchor

    def delete(self, table: str) -> None:
        with self._lock:
            self._kept.pop(table, None)


class StoredAnchors:
    """Anchors in a folder that every driver sees: one small file for each put, of which the newest version counts."""

    def __init__(self, store: Store):
        self.store = store

    def _folder(self, table: str) -> str:
        return f"{self.store.root}/{hashlib.sha256(table.encode()).hexdigest()}"

    def get(self, table: str) -> Anchor | None:
        names = [n for n in self.store.names(self._folder(table)) if n.endswith(".json")]
        if not names:
            return None
        raw = json.loads(self.store.read(f"{self._folder(table)}/{max(names)}"))
        return Anchor(raw["table"], raw["version"], frozenset(raw["processed"]))

    def put(self, anchor: Anchor) -> None:
        folder, name = self._folder(anchor.table), f"{anchor.version:020d}.json"
        try:
            self.store.create(f"{folder}/{name}", json.dumps({"table": anchor.table, "version": anchor.version, "processed": sorted(anchor.processed)}).encode())
        except ConflictError:
            return  # the same version was put before
        for old in self.store.names(folder):
            if old < name:
                self.store.delete(f"{folder}/{old}")

    def delete(self, table: str) -> None:
        self.store.delete(self._folder(table))
