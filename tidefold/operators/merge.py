"""Merge-on-read: deletes are left anti joins, pure functions of DataFrames.

Data rows carry hidden columns: file and position (position deletes), sequence (equality deletes). An anti join
never multiplies rows, so repeated deletes are harmless. Small delete sides are broadcast by Spark's own size
check; nothing is forced here, so huge ones turn into a shuffle join that AQE can split. With ``shuffle`` (deletes
known to be large) that join is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.config import SortColumn


def quoted(name: str) -> str:
    """A column's name as one part, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def apply_position_deletes(data: DataFrame, deletes: DataFrame, on: Sequence[str] = ("file_path", "pos")) -> DataFrame:
    d = deletes.select(*(F.col(quoted(k)).alias(f"_d_{n}") for n, k in enumerate(on)))
    return data.join(d, reduce(Column.__and__, (data[quoted(k)] == F.col(f"_d_{n}") for n, k in enumerate(on))), "left_anti")


def apply_equality_deletes(data: DataFrame, deletes: DataFrame, keys: Sequence[str], seq: str = "seq", delete_seq: str = "seq", null_safe: bool = False, shuffle: bool = False) -> DataFrame:
    """Drop rows that a delete with all keys equal and a strictly greater sequence hits. With null_safe, null keys
    equal each other; else they match nothing. With shuffle the deletes are never broadcast."""
    names = [f"_d_{n}" for n in range(len(keys))]
    d = deletes.select(*(F.col(quoted(k)).alias(n) for k, n in zip(keys, names)), F.col(quoted(delete_seq)).alias("_seq_d"))
    # Only the greatest sequence of a key matters, and deletes of one key collapse before the join.
    d = d.groupBy(*names).agg(F.max("_seq_d").alias("_seq_d"))
    if shuffle:
        d = d.hint("merge")
    same: list[Column] = [data[quoted(k)].eqNullSafe(F.col(n)) if null_safe else data[quoted(k)] == F.col(n) for k, n in zip(keys, names)]
    return data.join(d, reduce(Column.__and__, same) & (data[quoted(seq)] < F.col("_seq_d")), "left_anti")


def inline_equality(spark: SparkSession, columns: Mapping[str, str], values: Sequence[Sequence[object]], sequence: int, seq: str = "seq") -> tuple[tuple[str, ...], DataFrame]:
    """Equality deletes given as rows instead of a file: (keys, deletes with their sequence). columns: name to type."""
    schema = ", ".join(f"{quoted(k)} {t}" for k, t in columns.items())
    rows = spark.createDataFrame([tuple(v) for v in values], schema)
    return tuple(columns), rows.withColumn(seq, F.lit(sequence).cast("long"))


def inline_positions(spark: SparkSession, positions: Mapping[str | int, Sequence[int]], path: str = "file_path", pos: str = "pos", path_type: str = "string") -> DataFrame:
    """Position deletes given as positions of each file."""
    return spark.createDataFrame([(p, k) for p, some in positions.items() for k in some], f"{quoted(path)} {path_type}, {quoted(pos)} long")


def merge_on_read(data: DataFrame, columns: Sequence[str], positions: DataFrame | None = None, equality: Sequence[tuple[Sequence[str], DataFrame]] = (), null_safe: bool = False, sort: Sequence[SortColumn] = (), position_keys: Sequence[str] = ("file_path", "pos"), seq: str = "seq", shuffle: bool = False) -> DataFrame:
    """Position deletes, then equality deletes (those of one key set as one join), then projection and sort."""
    if positions is not None:
        data = apply_position_deletes(data, positions, position_keys)
    by_keys: dict[tuple[str, ...], DataFrame] = {}
    for keys, d in equality:
        d = d.select(*(quoted(k) for k in [*keys, seq]))
        by_keys[tuple(keys)] = by_keys[tuple(keys)].union(d) if tuple(keys) in by_keys else d
    for keys, d in by_keys.items():
        data = apply_equality_deletes(data, d, keys, seq, seq, null_safe, shuffle)
    out = data.select(*(quoted(c) for c in columns))
    return out.orderBy(*sort_keys(sort)) if sort else out


def sort_keys(columns: Sequence[SortColumn]) -> list[Column]:
    return [getattr(F.col(quoted(c.name)), f"{'desc' if c.descending else 'asc'}_nulls_{'first' if c.nulls_first else 'last'}")() for c in columns]
