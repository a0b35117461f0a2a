"""Reading a manifest's files, never a folder, with hidden columns computed from the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidefold.errors import PlanningError, SchemaError

#: Hidden columns; a table's own file_path, pos or seq columns stay apart from them.
PATH, POS, SEQ = "__file_path", "__pos", "__seq"
#: Sequences of up to so many files are broadcast (some 20 MB); those of more are joined by a shuffle.
BROADCAST_FILES = 100_000
#: Columns are found by their field ids, so a renamed column keeps its values.
BY_ID = {"spark.sql.parquet.fieldId.read.enabled": "true", "spark.sql.parquet.fieldId.read.ignoreMissing": "true"}
ID = "parquet.field.id"


def with_ids(schema: StructType) -> StructType:
    """Every field with an id: its own, or its place from 1 on."""
    return StructType([StructField(f.name, f.dataType, f.nullable, {**f.metadata, ID: int(f.metadata.get(ID, f.metadata.get("field_id", k)))}) for k, f in enumerate(schema.fields, 1)])


def fields_by_id(schema: StructType) -> dict[int, StructField]:
    return {f.metadata[ID]: f for f in with_ids(schema).fields}


def scan_data(spark: SparkSession, schema: StructType, files: Sequence[tuple[str, int]], positions: bool = True, sequences: bool = True) -> DataFrame:
    """The columns of a group's (path, sequence) files, with the hidden columns that are asked for."""
    if not files:
        raise PlanningError("no files to scan")
    df = spark.read.schema(schema).parquet(*(p for p, _ in files))
    hidden = [_scanned_path().alias(PATH)] if positions or sequences else []
    df = df.select("*", *hidden, *([F.col("_metadata.row_index").alias(POS)] if positions else []))
    return _sequenced(spark, df, files) if sequences else df


def _sequenced(spark: SparkSession, df: DataFrame, files: Sequence[tuple[str, int]]) -> DataFrame:
    known = {s for _, s in files}
    if len(known) == 1:
        return df.withColumn(SEQ, F.lit(known.pop()).cast("long"))
    seqs = spark.createDataFrame(list(files), f"{PATH} string, {SEQ} long")
    return df.join(F.broadcast(seqs) if len(files) <= BROADCAST_FILES else seqs.hint("merge"), PATH)


def _scanned_path() -> Column:
    """The file's path as the manifest spells it; the scan gives it URL-encoded."""
    plain = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def scan_position_deletes(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    if not paths:
        return None
    return spark.read.schema("file_path string, pos long").parquet(*paths).select(F.regexp_replace("file_path", "^file:/+", "/").alias(PATH), F.col("pos").alias(POS))


def scan_equality_deletes(spark: SparkSession, schema: StructType, files: Sequence[tuple[str, Sequence[int], int]]) -> list[tuple[tuple[str, ...], DataFrame]]:
    """(keys, deletes with their sequence) of each key set of the (path, field ids, sequence) files: one relation
    reads all files of a key set. Keys are resolved by field id."""
    fields = fields_by_id(schema)
    sets: dict[tuple[int, ...], list[tuple[str, int]]] = {}
    for path, ids, seq in files:
        if not ids or any(i not in fields for i in ids):
            raise SchemaError(f"{path}: equality ids {list(ids)} are not all in the schema")
        sets.setdefault(tuple(ids), []).append((path, seq))
    out = []
    for ids, some in sets.items():
        keys = [fields[i] for i in ids]
        df = spark.read.schema(StructType(keys)).parquet(*(p for p, _ in some)).select("*", _scanned_path().alias(PATH))
        out.append((tuple(k.name for k in keys), _sequenced(spark, df, some).drop(PATH)))
    return out
