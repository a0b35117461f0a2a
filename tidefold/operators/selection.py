"""Choosing and grouping files: filters and aggregates over a manifest DataFrame.

A manifest has file_path, size, content (data, position_deletes or equality_deletes) and a group or partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.config import PlanningConfig, Strategy
from tidefold.functions.metrics import ratio


def select_files(data: DataFrame, strategy: Strategy, config: PlanningConfig, size: str = "size", deletes: str = "n_deletes") -> DataFrame:
    if strategy is Strategy.SMALL_FILES:
        return data.where(F.col(size) <= config.small_file_threshold_bytes)
    if strategy is Strategy.FILES_WITH_DELETES:
        return data.where(F.col(deletes) >= config.min_delete_file_count_threshold)
    return data


def with_delete_counts(data: DataFrame, deletes: DataFrame, on: str) -> DataFrame:
    """Data files with the number of their delete files, both kinds together."""
    n = deletes.groupBy(on).agg(F.count("*").alias("n_deletes"))
    return data.join(n, on, "left").withColumn("n_deletes", F.coalesce("n_deletes", F.lit(0).cast("long")))


def file_deletes(data: DataFrame, deletes: DataFrame, on: str, path: str) -> DataFrame:
    """Data files with how many different delete files of either kind aim at them."""
    of = lambda kind: F.count(F.when(F.col("content") == kind, 1))
    both = dedup_deletes(deletes, on, path).groupBy(on).agg(of("position_deletes").alias("n_position"), of("equality_deletes").alias("n_equality"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return data.join(both, on, "left").select(*(c for c in data.columns), zero("n_position"), zero("n_equality"))


def dedup_deletes(deletes: DataFrame, group: str, path: str) -> DataFrame:
    """One row for each group, content and path."""
    return deletes.select(group, "content", path).distinct()


def group_sizes(files: DataFrame, group: str, size: str = "size") -> DataFrame:
    return files.groupBy(group).agg(F.sum(size).alias("total_bytes"), F.count("*").alias("n_files"))


def input_totals(files: DataFrame, group: str, size: str = "size") -> DataFrame:
    """Bytes and number of a group's data and delete files together."""
    return files.groupBy(group).agg(F.sum(size).alias("input_bytes"), F.count("*").alias("input_files"))


def by_threshold(groups: DataFrame, c: PlanningConfig) -> DataFrame:
    """The groups (n_files, total_bytes, n_deletes) worth a rewrite: too many files, a low average size, or more
    deletes a file than allowed."""
    n = F.col("n_files")
    return groups.where((n > c.max_file_count_per_partition) | (F.floor(F.col("total_bytes") / n) < c.small_file_threshold_bytes) | (F.col("n_deletes") > c.max_delete_ratio * n))


def partition_scores(groups: DataFrame) -> DataFrame:
    """Adds fragment_ratio (deletes a data file) and score to (n_files, n_deletes, n_small, hours): three tenths each
    for files (of 100) and fragments, two tenths each for hours since the last rewrite (of 24) and small files."""
    at_least_one = F.greatest(F.col("n_files"), F.lit(1))
    up_to_one = lambda x: F.least(x, F.lit(1.0))
    fragments = F.col("n_deletes") / at_least_one
    score = up_to_one(F.col("n_files") / 100) * 0.3 + fragments * 0.3 + up_to_one(F.col("hours") / 24) * 0.2 + F.col("n_small") / at_least_one * 0.2
    return groups.withColumn("fragment_ratio", fragments).withColumn("score", score)


def commit_totals(results: DataFrame, dry_run: bool = False) -> DataFrame:
    """What a commit of (status, files_removed, files_added, bytes_removed, bytes_added) would change: successes only;
    a dry run commits no task."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    tasks = F.lit(0) if dry_run else F.count("*")
    return results.where("status = 'Success'").agg(*map(total, ("files_removed", "files_added", "bytes_removed", "bytes_added")), tasks.cast("long").alias("tasks_committed"))


def task_totals(results: DataFrame) -> DataFrame:
    """completed, failed, success_per_mille, average_us and written_per_mille of (status, time_us, bytes_read,
    bytes_written); times and written bytes are those of successes."""
    done, failed = F.count(F.when(F.col("status") == "Success", 1)), F.count(F.when(F.col("status") == "Failed", 1))
    of_done = lambda c: F.coalesce(F.sum(F.when(F.col("status") == "Success", F.col(c))), F.lit(0))
    one = results.agg(done.alias("completed"), failed.alias("failed"), of_done("time_us").alias("us"), F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("read"), of_done("bytes_written").alias("written"))
    return one.select("completed", "failed", ratio(F.col("completed"), F.col("completed") + F.col("failed")).alias("success_per_mille"), ratio(F.col("us"), F.col("completed"), 1, 0).alias("average_us"), ratio(F.col("written"), F.col("read")).alias("written_per_mille"))


def executor_parallelism(total: Column, n: Column, c: PlanningConfig) -> Column:
    wanted = F.greatest(F.ceil(total / c.min_size_per_partition), F.ceil(n / c.max_file_count_per_partition))
    return F.greatest(F.lit(1), F.least(F.lit(c.max_parallelism), wanted)).cast("long")


def output_parallelism(total: Column, c: PlanningConfig) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(c.max_parallelism), F.ceil(total / c.target_file_size_bytes))).cast("long")


def parallelism(total: int, n: int, c: PlanningConfig) -> tuple[int, int]:
    """The same two numbers for one group on the driver."""
    wanted = max(-(-total // c.min_size_per_partition), -(-n // c.max_file_count_per_partition))
    return max(1, min(c.max_parallelism, wanted)), max(1, min(c.max_parallelism, -(-total // c.target_file_size_bytes)))


def unprocessed(manifest: DataFrame, anchors: DataFrame, path: str = "file_path") -> DataFrame:
    """Incremental planning: files no anchor has seen."""
    return manifest.join(anchors.select(path), path, "left_anti")
