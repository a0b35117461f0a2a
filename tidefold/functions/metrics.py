"""Counters of a driver, ratios over DataFrames and numbers alike, and their Prometheus text."""

from __future__ import annotations

import contextlib
import threading
import time
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The counters' names; times are in microseconds.
COUNTERS = (
    "tables_scanned", "files_selected", "tasks_created", "plans_created",
    "tasks_started", "tasks_completed", "tasks_failed",
    "bytes_read", "bytes_written", "rows_processed", "files_written",
    "total_execution_time_us", "total_read_time_us", "total_write_time_us",
    "commits_attempted", "commits_succeeded", "commits_failed",
)


class Metrics:
    def __init__(self) -> None:
        self._lock, self._counts = threading.Lock(), Counter(dict.fromkeys(COUNTERS, 0))

    def add(self, name: str, n: int = 1) -> None:
        if name not in COUNTERS:
            raise KeyError(name)
        with self._lock:
            self._counts[name] += n

    @contextlib.contextmanager
    def timed(self, name: str) -> Iterator[None]:
        start = time.monotonic()
        try:
            yield
        finally:
            self.add(name, int((time.monotonic() - start) * 1e6))

    def get(self, name: str) -> int:
        return self._counts[name]

    @property
    def success_rate(self) -> float:
        return success_rate(self.get("tasks_completed"), self.get("tasks_failed"))

    @property
    def compression_ratio(self) -> float:
        return self.get("bytes_written") / self.get("bytes_read") if self.get("bytes_read") else 1.0

    @property
    def average_task_us(self) -> int:
        return self.get("total_execution_time_us") // self.get("tasks_completed") if self.get("tasks_completed") else 0

    def prometheus(self, prefix: str = "tidefold") -> str:
        return "".join(f"# TYPE {prefix}_{k} counter\n{prefix}_{k} {v}\n" for k, v in sorted(self._counts.items()))


def success_rate(done: int, failed: int) -> float:
    return done / (done + failed) if done + failed else 1.0


def space_savings(removed: int, added: int) -> float:
    return 1 - added / removed if removed else 0.0


def ratio(part: Column, whole: Column, of: int = 1000, empty: int | None = None) -> Column:
    """part / whole as whole parts of ``of`` (rounded down); ``empty`` (``of`` if not given) where whole is 0."""
    return F.when(whole == 0, F.lit(of if empty is None else empty)).otherwise(F.floor(part.cast("decimal(38,0)") * of / whole)).cast("long")


def least_greatest_average(runs: Sequence[float]) -> tuple[float, float, float]:
    return (min(runs), max(runs), sum(runs) / len(runs)) if runs else (0.0, 0.0, 0.0)
