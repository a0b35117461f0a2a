"""Sessions with settings of their own, so that the caller's session stays as it is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession


def twin(spark: SparkSession, settings: Mapping[str, str]) -> SparkSession:
    """A session with the given one's settings and tables, and these settings on top."""
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in settings.items():
        out.conf.set(k, v)
    return out
