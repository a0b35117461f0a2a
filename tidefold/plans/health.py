"""Health of a worker over HTTP: whether it lives, takes tasks, and what it has done."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidefold.plans.worker import Worker


def health_status(worker: Worker, since: float) -> dict:
    m = worker.table.metrics
    return {"live": worker.live, "ready": worker.ready, "in_flight": worker.in_flight, "capacity": worker.capacity, "uptime_s": int(time.monotonic() - since), "tasks_completed": m.get("tasks_completed"), "tasks_failed": m.get("tasks_failed"), "success_rate": m.success_rate}


class HealthServer:
    """/health/live (/healthz), /health/ready (/readyz), /health/status (/health) and /metrics; 200, 503 or 404."""

    def __init__(self, worker: Worker, port: int = 0, host: str = "127.0.0.1"):
        since = time.monotonic()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                at = self.path.partition("?")[0]
                if at in ("/health/live", "/healthz"):
                    self.answer(worker.live, "OK" if worker.live else "NOT LIVE")
                elif at in ("/health/ready", "/readyz"):
                    self.answer(worker.ready, "OK" if worker.ready else "NOT READY")
                elif at in ("/health/status", "/health"):
                    self.answer(worker.live, json.dumps(health_status(worker, since)), "application/json")
                elif at == "/metrics":
                    self.answer(True, worker.table.metrics.prometheus())
                else:
                    self.send_error(404)

            def answer(self, good: bool, text: str, kind: str = "text/plain") -> None:
                self.send_response(200 if good else 503)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(text.encode())))
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *_: object) -> None: ...

        self._server = ThreadingHTTPServer((host, port), Handler)
        self.port = self._server.server_address[1]
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()
