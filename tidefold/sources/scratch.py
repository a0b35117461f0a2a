"""The folder for tables between, which the driver and all executors must share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tidefold.errors import ConfigError

_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master gets a folder of our own (tests); a cluster has none
    that we may choose for it, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = id(spark.sparkContext)
        if key not in _own:
            _own[key] = tempfile.mkdtemp(prefix="tidefold-")
            spark.sparkContext.setCheckpointDir(_own[key])
        named = _own[key]
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
