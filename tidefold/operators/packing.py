"""Bin packing of files: an order-dependent fold, run as one group for each partition of the table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame


def pack(weights: Sequence[int], target: int, lookback: int = 1) -> list[int]:
    """Bin of each item: heaviest first (equal ones in order), into the first of the last ``lookback`` bins that
    has room, else a new one. Items over the target stand alone."""
    bins: list[int] = []
    out = [0] * len(weights)
    for k in sorted(range(len(weights)), key=lambda k: -weights[k]):
        start = max(0, len(bins) - lookback)
        at = next((b for b in range(start, len(bins)) if bins[b] + weights[k] <= target), len(bins))
        if at == len(bins):
            bins.append(0)
        bins[at] += weights[k]
        out[k] = at
    return out


def bin_pack(files: DataFrame, partition: str, path: str, size: str, target: int, lookback: int = 1) -> DataFrame:
    """partition, path, size and bin (long, from 0) of each file; ties in order of path."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(path, kind="stable", ignore_index=True)
        return pdf.assign(bin=pack(pdf[size].tolist(), target, lookback))

    schema = f"{partition} {dict(files.dtypes)[partition]}, {path} {dict(files.dtypes)[path]}, {size} long, bin long"
    return files.select(partition, path, files[size].cast("long").alias(size)).groupBy(partition).applyInPandas(fold, schema)
