"""What Parquet footers say of files: rows, and each column's bytes, nulls and bounds by field id."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

#: Footers of more files are read by the executors.
FEW = 64
_BOUNDED = (bool, int, float, str, bytes)


def _plain(value: object) -> object:
    return base64.b64encode(value).decode() if isinstance(value, bytes) else value


def footer(path: str) -> tuple[int, str]:
    """Rows, and {field id: [bytes, nulls, least, greatest]} as JSON; types without bounds have none."""
    import pyarrow.fs

    place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (None, path)
    with pq.ParquetFile(place[1], filesystem=place[0]) as file:
        meta, arrow = file.metadata, file.schema_arrow
    ids = {f.name: (f.metadata or {}).get(b"PARQUET:field_id", b"").decode() for f in arrow}
    out: dict[str, list] = {}
    for c in range(meta.num_columns if meta.num_row_groups else 0):
        parts = [meta.row_group(g).column(c) for g in range(meta.num_row_groups)]
        name = parts[0].path_in_schema
        if name not in ids:  # inside a nested column
            continue
        stats = [p.statistics for p in parts]
        nulls = sum(s.null_count for s in stats) if all(s and s.has_null_count for s in stats) else None
        bounds = [(s.min, s.max) for s in stats if s and s.has_min_max and isinstance(s.min, _BOUNDED)]
        known = bounds if len(bounds) == sum(1 for s, p in zip(stats, parts) if not s or s.null_count != p.num_values) else []
        out[ids[name] or name] = [sum(p.total_compressed_size for p in parts), nulls, _plain(min(x for x, _ in known)) if known else None, _plain(max(y for _, y in known)) if known else None]
    return meta.num_rows, json.dumps(out)


def footers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[int, str]]:
    if len(paths) <= FEW:
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(paths, pool.map(footer, paths)))
    return {r.path: (r.rows, r.stats) for r in footer_table(spark, paths).collect()}


def footer_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, rows and stats of every file, read by the executors."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *footer(p)) for p in f["path"]], columns=["path", "rows", "stats"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(200, len(paths) // 50)))
    return listed.mapInPandas(read, "path string, rows long, stats string")
