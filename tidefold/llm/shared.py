"""Where intermediate tables go, how long they stay, and the session that operators run in."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Mapping
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tidefold.functions.sessions import twin
from tidefold.sources.scratch import shared_dir

_held: ContextVar[list[str] | None] = ContextVar("held", default=None)
#: Settings of the operators' own session. Arrow batches of bounded bytes keep memory flat however long single texts
#: are; shuffle files go once the query that made them has ended, as every result between is a written table.
LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := _held.get()) is not None:
        held.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession, keep: str | None = None) -> Iterator[None]:
    """Remove the folders given out inside, but for ``keep``, when the block ends."""
    held: list[str] = []
    token = _held.set(held)
    try:
        yield
    finally:
        _held.reset(token)
        dropped(spark, *(p for p in held if p != keep))


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame, written to the shared folder and read back: lineage is cut and every later job reads the same rows."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tidefold_path = path  # type: ignore[attr-defined]
    return back


def forget(*frames: DataFrame) -> None:
    """Remove written frames that nothing reads any more."""
    for f in frames:
        dropped(f.sparkSession, f._tidefold_path)  # type: ignore[attr-defined]


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove tables of ours that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = hadoop(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it none of the frame's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lean(df: DataFrame, more: Mapping[str, str] | None = None) -> DataFrame:
    """The frame in a session of the operators' own, with the caller's settings, LEAN and ``more``; the caller's session
    stays as it is. Frames of both sessions can be joined."""
    own = twin(df.sparkSession, LEAN | dict(more or {}))
    rows = own.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed())
    return DataFrame(rows, own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
