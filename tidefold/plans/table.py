"""A table as a folder of Parquet files and a versioned log, with atomic, optimistically retried commits.

A version is created exclusively, so of two writers one wins; the other reads the new version, checks that its
inputs are still live and that no newer position deletes aim at them, and tries again or gives up. Files carry their
partition, the deletes that aim at them are found by path, partition and sequence, and columns are read by field id.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidefold.config import CommitMode, ExecutionConfig, PlanningConfig, ShardingConfig, SortColumn, Strategy
from tidefold.errors import CommitError, ConfigError, ExecutionError, PlanningError, TableError
from tidefold.functions.ids import time_ordered_id
from tidefold.functions.metrics import Metrics, space_savings
from tidefold.functions.retry import COMMIT, STORAGE, retried
from tidefold.functions.sessions import twin
from tidefold.operators.merge import merge_on_read, quoted, sort_keys
from tidefold.operators.packing import pack
from tidefold.plans.anchors import Anchor, AnchorStore
from tidefold.plans.cache import ManifestCache
from tidefold.plans.files import MANIFEST, DeleteIndex, File, Group, Result, SizeEstimator, Task, build_task, partition_values, sort_order, sort_order_json, validate
from tidefold.plans.log import EVERY, Log, State
from tidefold.plans.worker import Worker
from tidefold.sources.footers import footer_table, footers
from tidefold.sources.reader import BY_ID, PATH, POS, SEQ, scan_data, scan_equality_deletes, scan_position_deletes, with_ids
from tidefold.sources.store import Store

#: Position deletes name their targets in the manifest up to so many files.
MOST_TARGETS = 1000
_PART, _NULL = "__part_{}", "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Summary:
    version: int
    files_removed: int = 0
    files_added: int = 0
    bytes_removed: int = 0
    bytes_added: int = 0
    tasks_committed: int = 0
    tasks_failed: int = 0
    errors: tuple[str, ...] = ()

    @property
    def savings(self) -> float:
        return space_savings(self.bytes_removed, self.bytes_added)


@dataclass
class Table:
    spark: SparkSession
    path: str
    metrics: Metrics = field(default_factory=Metrics)
    cache: ManifestCache | None = None
    put_if_absent: Callable[[str, bytes], bool] | None = None
    sharding: ShardingConfig = ShardingConfig()

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.path, self.put_if_absent)
        self.path, self.log = self.store.root, Log(self.store, self.sharding)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str] = (), sort_by: Sequence[SortColumn] = (), **more) -> Table:  # noqa: ANN003
        table = cls(spark, path, **more)
        schema = with_ids(schema)
        if missing := {*partition_by, *(c.name for c in sort_by)} - set(schema.names):
            raise ConfigError(f"no columns {sorted(missing)}")
        if table.log.versions():
            raise ConfigError(f"{path} is a table")
        table.log.append(0, {"schema": schema.jsonValue(), "properties": {"partition_by": list(partition_by), "sort_order": sort_order_json(sort_by)}, "add": [], "remove": []})
        return table

    @property
    def version(self) -> int:
        if not (known := self.log.versions()):
            raise PlanningError(f"no table at {self.path}")
        return known[-1]

    def state(self, version: int | None = None) -> State:
        """Schema, live files and properties of a version, the last one if none is given."""
        at = self.version if version is None else version
        load = lambda: retried(lambda: self.log.load(self.spark, at), STORAGE)
        return self.cache.get(self.path, at, load) if self.cache else load()

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live files as a DataFrame, with the number of deletes that aim at each data file."""
        files = self.state(version).files
        index = DeleteIndex(f for f in files if f.content != "data")
        rows = [(*asdict(f).values(), len(index.of(f)) if f.content == "data" else 0) for f in files]
        return self.spark.createDataFrame(rows, MANIFEST + ", n_deletes long")

    def _commit(self, change: Callable[[State, int], tuple[list[File], list[str], StructType]]) -> int:
        def attempt() -> int:
            at = self.version
            state = self.state(at)
            add, remove, schema = change(state, at)
            self.log.append(at + 1, {"schema": schema.jsonValue(), "properties": state.properties, "add": [asdict(f) for f in add], "remove": remove})
            return at + 1

        self.metrics.add("commits_attempted")
        try:
            version = retried(attempt, COMMIT)
        except TableError:
            self.metrics.add("commits_failed")
            raise
        self.metrics.add("commits_succeeded")
        if version % EVERY == 0:
            self.log.checkpoint(self.spark, version, self.state(version).files)
        return version

    def rename_column(self, old: str, new: str) -> int:
        """Files stay as they are: columns are found by field id."""

        def change(state: State, at: int) -> tuple[list[File], list[str], StructType]:
            raw = state.schema.jsonValue()
            if old not in state.schema.names or new in state.schema.names or old in state.properties["partition_by"]:
                raise ConfigError(f"{old} cannot become {new}")
            return [], [], StructType.fromJson(raw | {"fields": [f | {"name": new if f["name"] == old else f["name"]} for f in raw["fields"]]})

        return self._commit(change)

    def _write(self, df: DataFrame, schema: StructType, folder: str, by: Sequence[str], config: ExecutionConfig, rows_a_file: int = 0) -> None:
        """Every file holds all columns, with their field ids, and rows of one partition."""
        named = df.select(*(F.col(quoted(f.name)).alias(f.name, metadata=f.metadata) for f in schema.fields))
        parts = [_PART.format(k) for k in range(len(by))]
        writer = named.withColumns({p: F.col(quoted(b)).cast("string") for p, b in zip(parts, by)}).write if by else named.write
        writer = writer.option("compression", config.compression).option("parquet.block.row.count.limit", config.row_group_rows).option("maxRecordsPerFile", rows_a_file)
        (writer.partitionBy(*parts) if by else writer).parquet(folder)

    def _files(self, folder: str, seq: int, by: Sequence[str] = (), content: str = "data", ids: Sequence[int] = (), targets: tuple[str, ...] | None = None) -> list[File]:
        """What was written to a folder; files without rows are left out."""
        listed = [f for f in self.store.list(folder) if f.path.endswith(".parquet")]
        if self.store.scheme == "file":
            known = footers(self.spark, [f.path for f in listed])
        else:  # rows as Spark counts them, without statistics
            counted = self.spark.read.parquet(*(f.path for f in listed)).groupBy(F.col("_metadata.file_path").alias("p")).count().collect() if listed else []
            known = {unquote(r.p): (r["count"], "{}") for r in counted}
        out = []
        for f in sorted(listed, key=lambda f: f.path):
            rows, stats = known.get(f.path, (0, "{}"))
            found = dict(x.split("=", 1) for x in f.path[len(folder) :].split("/") if x.startswith("__part_"))
            values = [unquote(found[_PART.format(k)]) for k in range(len(by))]
            if rows:
                out.append(File(f.path, f.size, rows, seq, content, tuple(ids), tuple(None if v == _NULL else v for v in values), targets, stats))
        return out

    def append(self, df: DataFrame, content: str = "data", equality_ids: Sequence[int] = ()) -> int:
        """Write rows as data files, position deletes (file_path, pos) or equality deletes (keys) of a new version.
        Equality deletes whose keys hold all partition columns are kept by partition, others aim at all of them."""
        state = self.state()
        folder, by, schema, targets = f"{self.path}/data/{time_ordered_id()}", state.properties["partition_by"], state.schema, None
        if content != "data":
            ids = {f.metadata["parquet.field.id"]: f for f in schema.fields}
            if unknown := [i for i in equality_ids if i not in ids]:
                raise PlanningError(f"no fields {unknown}")
            if content == "position_deletes":
                named = [r[0] for r in df.select(F.regexp_replace("file_path", "^file:/+", "/")).distinct().limit(MOST_TARGETS + 1).collect()]
                targets = tuple(sorted(t for t in named if t is not None)) if len(named) <= MOST_TARGETS else None
                schema, by = StructType([f for f in df.schema.fields if f.name in ("file_path", "pos")]), []
            else:
                schema = StructType([ids[i] for i in equality_ids])
                by = by if set(by) <= set(schema.names) else []
        self._write(df, schema, folder, by, ExecutionConfig())
        return self._commit(lambda s, at: (self._files(folder, at + 1, by, content, equality_ids, targets), [], s.schema))

    def _merged(self, spark: SparkSession, schema: StructType, files: Sequence[File], deletes: Sequence[File], config: ExecutionConfig, inline: Sequence[tuple[tuple[str, ...], DataFrame]] = ()) -> DataFrame:
        least = min(f.seq for f in files)
        at_rows = [f for f in deletes if f.content == "position_deletes"]
        at_keys = [f for f in deletes if f.content == "equality_deletes" and f.seq > least]
        data = scan_data(spark, schema, [(f.path, f.seq) for f in files], positions=bool(at_rows), sequences=bool(at_keys or inline))
        positions = scan_position_deletes(spark, [f.path for f in at_rows])
        equality = scan_equality_deletes(spark, schema, [(f.path, f.equality_ids, f.seq) for f in at_keys])
        # Deletes of more file bytes than this are never broadcast, however small the optimizer takes them to be.
        limit = config.broadcast_delete_bytes
        if positions is not None and sum(f.size for f in at_rows) > limit:
            positions = positions.hint("merge")
        equality += [(keys, d.withColumnRenamed("seq", SEQ)) for keys, d in inline]
        return merge_on_read(data, schema.names, positions, equality, config.null_safe_keys, position_keys=(PATH, POS), seq=SEQ, shuffle=sum(f.size for f in at_keys) > limit)

    def read(self, version: int | None = None, config: ExecutionConfig = ExecutionConfig(), inline: Sequence[tuple[tuple[str, ...], DataFrame]] = ()) -> DataFrame:
        """Live rows; ``inline`` are equality deletes given as rows (see operators.merge.inline_equality)."""
        schema, files, _ = self.state(version)
        data = [f for f in files if f.content == "data"]
        self.metrics.add("tables_scanned")
        if not data:
            return self.spark.createDataFrame([], schema)
        return self._merged(twin(self.spark, BY_ID), schema, data, [f for f in files if f.content != "data"], config, inline)

    def plan(self, strategy: Strategy = Strategy.SMALL_FILES, config: PlanningConfig = PlanningConfig(), processed: frozenset[str] = frozenset(), version: int | None = None) -> list[Group]:
        """Groups of data files to rewrite, each of one partition, with the deletes that aim at them."""
        files = self.state(version).files
        index = DeleteIndex(d for d in files if d.content != "data")
        data = [f for f in sorted(files, key=lambda f: f.path) if f.content == "data" and f.path not in processed]
        if strategy is Strategy.SMALL_FILES:
            data = [f for f in data if f.size <= config.small_file_threshold_bytes]
        elif strategy is Strategy.FILES_WITH_DELETES:
            data = [f for f in data if len(index.of(f)) >= config.min_delete_file_count_threshold]
        by_partition: dict[tuple[str | None, ...], list[File]] = {}
        for f in data:
            by_partition.setdefault(f.partition, []).append(f)
        groups = []
        for some in by_partition.values():
            bins = [0] * len(some) if config.bin_pack_bytes is None else pack([f.size for f in some], config.bin_pack_bytes, config.lookback)
            packed: dict[int, list[File]] = {}
            for f, b in zip(some, bins):
                packed.setdefault(b, []).append(f)
            groups += [index.group(packed[b]) for b in sorted(packed)]
        groups = [g for g in groups if g.worth_it(config)] if config.by_threshold else groups
        self.metrics.add("plans_created")
        self.metrics.add("files_selected", sum(len(g.data) for g in groups))
        return groups

    def tasks(self, groups: Sequence[Group], planning: PlanningConfig = PlanningConfig(), execution: ExecutionConfig = ExecutionConfig(), version: int | None = None) -> list[Task]:
        at = self.version if version is None else version
        schema, _, properties = self.state(at)
        self.metrics.add("tasks_created", len(groups))
        return [build_task(self.path, g, schema, properties["partition_by"], properties["sort_order"], at, planning, execution) for g in groups]

    def execute(self, task: Task, sizes: SizeEstimator | None = None) -> Result:
        """Rewrite one group; never raises. The scan and the joins run on as many tasks as the group has splits, at
        least ``task.executors``; a shuffle then deals the rows to the outputs."""
        start, group, config = time.monotonic(), task.group, task.execution
        took = lambda: int((time.monotonic() - start) * 1000)
        self.metrics.add("tasks_started")
        try:
            if not group.data:
                raise PlanningError("empty group")
            schema = StructType.fromJson(json.loads(task.schema))
            partition_values(group.data[0], schema, task.partition_by)  # refuses partitions that have no plain form
            spark = twin(self.spark, BY_ID | {"spark.sql.files.minPartitionNum": str(task.executors)})
            df = self._merged(spark, schema, group.data, group.deletes, config)
            sizes = sizes or SizeEstimator(config.size_smoothing)
            sizes.seed(group.data)
            n = max(1, -(-group.total_bytes // config.target_file_size_bytes))
            order = sort_keys(config.sort_columns or sort_order(task.sort_order))
            df = df.repartitionByRange(n, *order).sortWithinPartitions(*order) if order else df.repartition(n)
            folder = f"{task.output}/{task.task_id}"
            with self.metrics.timed("total_write_time_us"):
                # One partition, so the writer need not sort by it and lose the order of rows.
                self._write(df, schema, folder, (), config, sizes.rows_a_file(config.target_file_size_bytes, config.max_rows_per_file))
            # The greatest input sequence: later equality deletes still aim at the new files.
            added = [replace(f, partition=group.partition) for f in self._files(folder, max(f.seq for f in group.data))]
            sizes.finished(added)
            self.metrics.add("tasks_completed")
            self.metrics.add("total_execution_time_us", took() * 1000)
            self.metrics.add("bytes_read", group.input_bytes)
            self.metrics.add("bytes_written", sum(f.size for f in added))
            self.metrics.add("files_written", len(added))
            self.metrics.add("rows_processed", sum(f.rows for f in added))
            return Result(task.task_id, "Success", group.data, tuple(added), sum(f.rows for f in group.data), sum(f.rows for f in added), took(), version=task.version)
        except Exception as e:  # noqa: BLE001  a failed task is a row of the results
            self.metrics.add("tasks_failed")
            return Result(task.task_id, "Failed", group.data, elapsed_ms=took(), error=f"{type(e).__name__}: {str(e)[:2000]}")

    def commit(self, results: Sequence[Result], base: int, mode: CommitMode = CommitMode.PLANNER, all_or_nothing: bool = False) -> Summary:
        """Swap the files of all successful results in one new version; mode NONE only adds up what would change.
        Failed and cancelled tasks are reported, and with all_or_nothing nothing is committed beside them."""
        if mode is CommitMode.WORKER:
            raise ConfigError("workers do not commit; results are committed together")
        good = [r for r in results if r.status == "Success"]
        errors = tuple(f"{r.task_id}: {r.status} {r.error}".strip() for r in results if r.status != "Success")
        for r in good:
            validate(r)
        if errors and all_or_nothing and mode is not CommitMode.NONE:
            raise ExecutionError("nothing is committed: " + "; ".join(errors))
        removed, added = [f for r in good for f in r.removed], [f for r in good for f in r.added]
        one = Summary(base, len(removed), len(added), sum(f.size for f in removed), sum(f.size for f in added), 0, len(errors), errors)
        if mode is CommitMode.NONE or not good:
            return replace(one, version=self.version)
        gone, new = {f.path for f in removed}, {f.path for f in added}
        if len(gone) != len(removed):
            raise CommitError("two results remove the same file")
        # What the tasks knew, whatever the caller takes for the base.
        known = {f.path for f in self.state(min([base, *(r.version for r in good if r.version is not None)])).files}

        def change(state: State, at: int) -> tuple[list[File], list[str], StructType]:
            live = {f.path for f in state.files}
            if gone - live:
                raise CommitError("an input is no longer live")
            if any(f.content == "position_deletes" and f.path not in known and (f.targets is None or gone & set(f.targets)) for f in state.files):
                raise CommitError("new position deletes may aim at an input")
            # Deletes known to the tasks were applied to all rows of the outputs; only newer ones still aim at them.
            index = DeleteIndex(f for f in state.files if f.content != "data")
            needed = {d.path for f in state.files if f.content == "data" and f.path not in gone for d in index.of(f)}
            needed |= {d.path for f in added for d in index.of(f) if d.content == "equality_deletes" and d.path not in known}
            spent = [f.path for f in state.files if f.content != "data" and f.path not in needed]
            return added, [*sorted(gone), *spent], state.schema

        version = self._commit(change)
        return replace(one, version=version, tasks_committed=len(good))

    def compact(self, strategy: Strategy = Strategy.FULL, planning: PlanningConfig = PlanningConfig(), execution: ExecutionConfig = ExecutionConfig(), anchors: AnchorStore | None = None) -> Summary:
        """Plan, rewrite the groups (execution.concurrent_groups at a time) and commit. With anchors, files that an
        earlier call wrote are left alone, and those of this call are remembered."""
        base = self.version
        last = anchors.get(self.path) if anchors else None
        groups = self.plan(strategy, planning, last.processed if last else frozenset(), base)
        worker, sizes = Worker(self, execution.concurrent_groups), SizeEstimator(execution.size_smoothing)
        results = worker.run(self.tasks(groups, planning, execution, base), sizes)
        done = self.commit(results, base, all_or_nothing=execution.all_or_nothing)
        if anchors:
            live = {f.path for f in self.state().files}
            written = {f.path for r in results if r.status == "Success" for f in r.added}
            anchors.put(Anchor(self.path, done.version, frozenset((set(last.processed) if last else set()) & live | written & live)))
        return done

    def expire(self, keep_versions: int = 10, older_than_s: float = 86_400) -> int:
        """Forget all but the newest versions and remove files that none of them has, if they are older than that
        (younger ones may belong to a running task). The number of removed files."""
        kept = self.log.versions()[-max(1, keep_versions) :]
        live = {f.path for v in kept for f in self.state(v).files}
        self.log.checkpoint(self.spark, kept[0], self.state(kept[0]).files)
        self.log.truncate(kept[0])
        before, gone = (time.time() - older_than_s) * 1000, 0
        for f in list(self.store.list(f"{self.path}/data")):
            if f.path not in live and f.changed_ms < before:
                self.store.delete(f.path)
                gone += 1
        return gone

    def statistics(self, version: int | None = None) -> DataFrame:
        """Bytes, null counts and bounds of every column (by field id and name) of every live data file, as the
        manifest has them."""
        schema, files, _ = self.state(version)
        names = {str(f.metadata["parquet.field.id"]): f.name for f in schema.fields}
        known = self.spark.createDataFrame([(f.path, f.rows, f.stats) for f in files if f.content == "data"], "file_path string, rows long, stats string")
        each = known.select("file_path", "rows", F.explode(F.from_json("stats", "map<string,array<string>>")).alias("id", "s"))
        named = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        at = lambda k: F.col("s")[k]
        return each.select("file_path", F.col("id").cast("int").alias("field_id"), named[F.col("id")].alias("column"), at(0).cast("long").alias("bytes"), at(1).cast("long").alias("nulls"), at(2).alias("least"), at(3).alias("greatest"))

    def footer_statistics(self, version: int | None = None) -> DataFrame:
        """path, rows and statistics of every live data file, read anew from the footers by the executors."""
        return footer_table(self.spark, [f.path for f in self.state(version).files if f.content == "data"])
