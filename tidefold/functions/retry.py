"""Backoff for driver-side work; Spark itself retries tasks."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from tidefold.errors import TableError

T = TypeVar("T")


@dataclass(frozen=True)
class Backoff:
    """``retries`` more attempts after the first; a delay gets up to ``jitter`` of itself on top, within the cap."""

    retries: int = 3
    first_ms: int = 100
    factor: float = 2.0
    cap_ms: int = 30_000
    jitter: float = 0.0

    def delay_ms(self, attempt: int, chance: Callable[[], float] = random.random) -> int:
        delay = min(self.cap_ms, int(self.first_ms * self.factor**attempt))
        return min(self.cap_ms, int(delay * (1 + self.jitter * chance()))) if self.jitter else delay


STORAGE = Backoff(5, 200, 2.0, 30_000, 0.2)
NETWORK = Backoff(3, 100, 2.0, 10_000, 0.15)
COMMIT = Backoff(5, 50, 1.5, 5_000, 0.25)
NEVER = Backoff(0)


def retried(work: Callable[[], T], backoff: Backoff, sleep: Callable[[float], None] = time.sleep) -> T:
    """Call until it works; errors that are not retryable, and the last one, are raised."""
    attempt = 0
    while True:
        try:
            return work()
        except TableError as e:
            if not e.retryable or attempt >= backoff.retries:
                raise
            sleep(max(backoff.delay_ms(attempt), e.delay_ms) / 1000)
            attempt += 1
