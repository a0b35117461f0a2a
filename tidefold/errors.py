"""Errors, and which of them are worth another attempt."""

from __future__ import annotations


class TableError(Exception):
    retryable = False
    delay_ms = 0

    def with_context(self, text: str) -> TableError:
        return type(self)(f"{text}: {self}")


class PlanningError(TableError): ...
class ExecutionError(TableError): ...
class SchemaError(TableError): ...
class ConfigError(TableError): ...
class SerializationError(TableError): ...
class WorkerError(TableError): ...
class CommitError(TableError): ...


class CommunicationError(TableError):
    retryable, delay_ms = True, 100


class StorageError(TableError):
    retryable, delay_ms = True, 200


class TimeoutExceeded(TableError):
    retryable, delay_ms = True, 1000


class ResourceExhausted(TableError):
    retryable, delay_ms = True, 5000


class ConflictError(TableError):
    retryable, delay_ms = True, 50
