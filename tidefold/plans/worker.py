"""Groups rewritten side by side: each task is a Spark job group, so it can be watched and cancelled."""

from __future__ import annotations

import signal
import threading
import time
from collections import deque
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace
from typing import TYPE_CHECKING

from tidefold.errors import ResourceExhausted, TimeoutExceeded, WorkerError

if TYPE_CHECKING:
    from tidefold.plans.files import Result, SizeEstimator, Task
    from tidefold.plans.table import Table


class Worker:
    """Takes up to ``capacity`` tasks at a time; Spark owns the executors and retries what they lose."""

    def __init__(self, table: Table, capacity: int = 4):
        self.table, self.capacity = table, capacity
        self._pool, self._lock = ThreadPoolExecutor(capacity), threading.Lock()
        self._tasks: dict[str, Future] = {}
        self._cancelled: set[str] = set()
        self._open, self.live = True, True

    @property
    def in_flight(self) -> int:
        return sum(not t.done() for t in self._tasks.values())

    @property
    def ready(self) -> bool:
        return self.live and self._open and self.in_flight < self.capacity

    def submit(self, task: Task, sizes: SizeEstimator | None = None) -> str:
        with self._lock:
            if not self.ready:
                raise ResourceExhausted("draining" if not self._open else f"{self.capacity} tasks are in flight")
            self._tasks[task.task_id] = self._pool.submit(self._run, task, sizes)
            return task.task_id

    def submit_json(self, text: str) -> str:
        """A task in its JSON form."""
        from tidefold.plans.files import Task

        return self.submit(Task.from_json(text))

    def _run(self, task: Task, sizes: SizeEstimator | None) -> Result:
        from tidefold.plans.files import Result

        if task.task_id in self._cancelled:
            return Result(task.task_id, "Cancelled", task.group.data)
        self.table.spark.sparkContext.setJobGroup(task.task_id, f"compact {len(task.group.data)} files", interruptOnCancel=True)
        return self.table.execute(task, sizes)

    def run(self, tasks: Sequence[Task], sizes: SizeEstimator | None = None) -> list[Result]:
        """All tasks, as many at a time as there is room for."""
        waiting: deque[str] = deque()
        results = []
        for task in tasks:
            if len(waiting) == self.capacity:
                results.append(self.result(waiting.popleft()))
            waiting.append(self.submit(task, sizes))
        results += [self.result(t) for t in waiting]
        self.drain()
        return results

    def status(self, task: str) -> str:
        """Running, Success, Failed or Cancelled."""
        if task not in self._tasks:
            raise WorkerError(f"no task {task}")
        if task in self._cancelled:
            return "Cancelled"
        return self._tasks[task].result().status if self._tasks[task].done() else "Running"

    def result(self, task: str, timeout: float | None = None) -> Result:
        """The task's result; that of a cancelled task says so and may be committed beside others."""
        try:
            found = self._tasks[task].result(timeout)
        except TimeoutError:
            raise TimeoutExceeded(f"{task} after {timeout} s") from None
        return replace(found, status="Cancelled", added=(), rows_out=0) if task in self._cancelled else found

    def cancel(self, task: str) -> bool:
        """Whether the task was still running."""
        with self._lock:
            if task not in self._tasks or self._tasks[task].done():
                return False
            self._cancelled.add(task)
        self.table.spark.sparkContext.cancelJobGroup(task)
        return True

    def drain(self, timeout: float = 30.0) -> bool:
        """Take no more tasks, and wait for those in flight; whether all ended in time."""
        self._open = False
        end = time.monotonic() + timeout
        while self.in_flight and time.monotonic() < end:
            time.sleep(0.05)
        self._pool.shutdown(wait=False)
        return not self.in_flight

    def drain_on_signals(self, timeout: float = 30.0) -> None:
        """SIGTERM and SIGINT drain the worker; call it on the main thread."""
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: threading.Thread(target=self.drain, args=(timeout,), daemon=True).start())
