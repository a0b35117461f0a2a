"""Files, groups, tasks and results: what planner, workers and commit exchange, each with a JSON form."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql.types import DataType, StructType

from tidefold.config import ExecutionConfig, PlanningConfig, SortColumn
from tidefold.errors import CommitError, ConfigError, SchemaError, SerializationError
from tidefold.functions.ids import time_ordered_id
from tidefold.operators.selection import parallelism

MANIFEST = "path string, size long, rows long, seq long, content string, equality_ids array<int>, partition array<string>, targets array<string>, stats string"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    rows: int
    seq: int
    content: str = "data"
    equality_ids: tuple[int, ...] = ()
    #: Values of the table's partition columns as strings.
    partition: tuple[str | None, ...] = ()
    #: The data files that position deletes aim at; None if they are too many to list.
    targets: tuple[str, ...] | None = None
    #: {field id: [bytes, nulls, least, greatest]} as JSON.
    stats: str = "{}"

    @classmethod
    def of(cls, raw: dict) -> File:
        return cls(**raw | {"equality_ids": tuple(raw["equality_ids"]), "partition": tuple(raw["partition"]), "targets": None if raw["targets"] is None else tuple(raw["targets"])})


def partition_values(file: File, schema: StructType, by: Sequence[str]) -> dict[str, object]:
    """A file's partition as typed values; types without a plain string form are refused."""
    out: dict[str, object] = {}
    for name, text in zip(by, file.partition):
        kind: DataType = schema[name].dataType
        cast = {"string": str, "integer": int, "long": int, "short": int, "byte": int, "boolean": lambda t: t == "true", "date": str, "float": float, "double": float}.get(kind.typeName())
        if cast is None:
            raise SchemaError(f"{name}: no partitions by {kind.simpleString()}")
        out[name] = None if text is None else cast(text)
    return out


@dataclass(frozen=True)
class Group:
    """Data files to rewrite together, and the delete files that aim at any of them, each once and in order of path."""

    data: tuple[File, ...]
    deletes: tuple[File, ...] = ()

    @property
    def partition(self) -> tuple[str | None, ...]:
        return self.data[0].partition if self.data else ()

    @property
    def total_bytes(self) -> int:
        return sum(f.size for f in self.data)

    @property
    def input_bytes(self) -> int:
        return self.total_bytes + sum(f.size for f in self.deletes)

    @property
    def input_files(self) -> int:
        return len(self.data) + len(self.deletes)

    def worth_it(self, c: PlanningConfig) -> bool:
        """The threshold rule, as operators.selection.by_threshold."""
        n = len(self.data)
        return bool(n) and (n > c.max_file_count_per_partition or self.total_bytes // n < c.small_file_threshold_bytes or len(self.deletes) > c.max_delete_ratio * n)


class DeleteIndex:
    """Which deletes aim at a data file. Position deletes aim at the files they name; equality deletes at files of
    lesser sequence in their partition, or anywhere if they have none."""

    def __init__(self, deletes: Iterable[File]):
        self.anywhere: list[File] = []
        self.by_path: dict[str, list[File]] = {}
        self.by_partition: dict[tuple[str | None, ...], list[File]] = {}
        for d in sorted(deletes, key=lambda f: f.path):
            if d.content == "equality_deletes":
                self.by_partition.setdefault(d.partition, []).append(d)
            elif d.targets is None:
                self.anywhere.append(d)
            else:
                for t in d.targets:
                    self.by_path.setdefault(t, []).append(d)

    def of(self, file: File) -> list[File]:
        keys = {file.partition, ()}
        return [*self.anywhere, *self.by_path.get(file.path, ()), *(d for k in keys for d in self.by_partition.get(k, ()) if file.seq < d.seq)]

    def group(self, data: Sequence[File]) -> Group:
        found = {d.path: d for f in data for d in self.of(f)}
        return Group(tuple(data), tuple(found[p] for p in sorted(found)))


def sort_order_json(columns: Sequence[SortColumn]) -> str | None:
    return json.dumps([asdict(c) for c in columns]) if columns else None


def sort_order(text: str | None) -> tuple[SortColumn, ...]:
    return tuple(SortColumn(**c) for c in json.loads(text)) if text else ()


@dataclass(frozen=True)
class Task:
    """All that a worker needs to rewrite one group."""

    task_id: str
    group: Group
    schema: str
    partition_by: tuple[str, ...]
    sort_order: str | None
    output: str
    version: int
    executors: int
    outputs: int
    execution: ExecutionConfig = field(default=ExecutionConfig())

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Task:
        try:
            raw = json.loads(text)
            group = Group(*(tuple(File.of(f) for f in raw["group"][k]) for k in ("data", "deletes")))
            execution = ExecutionConfig(**raw["execution"] | {"sort_columns": tuple(SortColumn(**c) for c in raw["execution"]["sort_columns"])})
            return cls(**raw | {"group": group, "partition_by": tuple(raw["partition_by"]), "execution": execution})
        except (ValueError, KeyError, TypeError) as e:
            raise SerializationError(f"not a task: {e}") from None


def build_task(location: str, group: Group, schema: StructType, partition_by: Sequence[str], order: str | None, version: int, planning: PlanningConfig, execution: ExecutionConfig) -> Task:
    """Outputs go to the table's data folder; the task's id orders tasks by time and names its files."""
    executors, outputs = parallelism(group.total_bytes, len(group.data), planning)
    return Task(time_ordered_id(), group, schema.json(), tuple(partition_by), order, f"{location}/data", version, executors, outputs, execution)


@dataclass(frozen=True)
class Result:
    """Status is Success, Failed or Cancelled; outputs is JSON (path, size, count and partition of every file)."""

    task_id: str
    status: str
    removed: tuple[File, ...] = ()
    added: tuple[File, ...] = ()
    rows_in: int = 0
    rows_out: int = 0
    elapsed_ms: int = 0
    error: str = ""
    #: The version that the task was planned with: later deletes are not applied.
    version: int | None = None

    @property
    def outputs(self) -> str:
        return json.dumps([{"path": f.path, "size": f.size, "count": f.rows, "partition": list(f.partition)} for f in self.added])


def validate(result: Result, outputs: str | None = None) -> None:
    """A result that may be committed: a success whose outputs are readable JSON, with a file unless no row is left."""
    if result.status != "Success":
        raise CommitError(f"{result.task_id}: {result.status} {result.error}")
    try:
        files = json.loads(result.outputs if outputs is None else outputs)
    except ValueError:
        raise CommitError(f"{result.task_id}: outputs are no JSON") from None
    if not files and result.rows_out:
        raise CommitError(f"{result.task_id}: no output files for {result.rows_out} rows")


class SizeEstimator:
    """Bytes a row of outputs: first those of the inputs, then with each finished group's own mixed in."""

    def __init__(self, smoothing: float):
        if not 0 <= smoothing <= 1:
            raise ConfigError("the smoothing lies between 0 and 1")
        self.smoothing, self.bytes_a_row = smoothing, 0.0

    def seed(self, files: Sequence[File]) -> None:
        if not self.bytes_a_row and (rows := sum(f.rows for f in files)):
            self.bytes_a_row = sum(f.size for f in files) / rows

    def finished(self, files: Sequence[File]) -> None:
        if rows := sum(f.rows for f in files):
            actual = sum(f.size for f in files) / rows
            self.bytes_a_row = self.smoothing * actual + (1 - self.smoothing) * self.bytes_a_row if self.bytes_a_row else actual

    def rows_a_file(self, target_bytes: int, most_rows: int | None) -> int:
        """0 for no limit."""
        sized = [max(1, int(target_bytes / self.bytes_a_row))] if self.bytes_a_row else []
        return min([*sized, *([most_rows] if most_rows else [])], default=0)
