"""Settings, with the defaults of the planner and of execution."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

MIB = 1 << 20


class Strategy(Enum):
    SMALL_FILES = "small_files"
    FULL = "full"
    FILES_WITH_DELETES = "files_with_deletes"


class CommitMode(Enum):
    PLANNER = "planner"
    WORKER = "worker"
    NONE = "none"


@dataclass(frozen=True)
class PlanningConfig:
    target_file_size_bytes: int = 1024 * MIB
    small_file_threshold_bytes: int = 32 * MIB
    min_delete_file_count_threshold: int = 1
    max_parallelism: int = 16
    min_size_per_partition: int = 256 * MIB
    max_file_count_per_partition: int = 100
    #: None: one group for each partition; else bins of that many bytes.
    bin_pack_bytes: int | None = 1024 * MIB
    lookback: int = 1
    #: Rewrite only groups that the threshold rule asks for: many files, a low average size or many deletes a file.
    by_threshold: bool = False
    max_delete_ratio: float = 0.1


@dataclass(frozen=True)
class SortColumn:
    name: str
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class ExecutionConfig:
    target_file_size_bytes: int = 1024 * MIB
    row_group_rows: int = 100_000
    compression: str = "zstd"
    null_safe_keys: bool = False
    #: Deletes beyond this many bytes of files are joined by a shuffle, others may be broadcast.
    broadcast_delete_bytes: int = 64 * MIB
    sort_columns: tuple[SortColumn, ...] = field(default=())
    #: Groups rewritten at the same time.
    concurrent_groups: int = 4
    #: A file ends at the target size, as estimated from bytes a row, or at this many rows.
    max_rows_per_file: int | None = None
    #: Weight of a finished group's bytes a row against the estimate so far.
    size_smoothing: float = 0.2
    #: Commit nothing if any group fails.
    all_or_nothing: bool = False


@dataclass(frozen=True)
class ShardingConfig:
    """Log entries are read by so many readers once there are more than the threshold."""

    threshold: int = 100
    readers: int = 8
