"""Hadoop file-system settings for object stores; values are never logged."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidefold.errors import ConfigError


def filesystem_conf(url: str, *, endpoint: str | None = None, region: str = "us-east-1", access_key: str | None = None, secret_key: str | None = None, service_account_file: str | None = None, account: str | None = None, account_key: str | None = None) -> dict[str, str]:
    """Settings for a path's scheme; given keys switch the default credential chain off."""
    scheme = url.partition("://")[0] if "://" in url else "file"
    if scheme in ("s3", "s3a"):
        out = {"spark.hadoop.fs.s3a.endpoint.region": region}
        if endpoint:
            out |= {"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.path.style.access": "true", "spark.hadoop.fs.s3a.connection.ssl.enabled": str(not endpoint.startswith("http://")).lower()}
        if access_key and secret_key:
            out |= {"spark.hadoop.fs.s3a.access.key": access_key, "spark.hadoop.fs.s3a.secret.key": secret_key, "spark.hadoop.fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"}
        return out
    if scheme == "gs":
        return {"spark.hadoop.google.cloud.auth.service.account.json.keyfile": service_account_file} if service_account_file else {}
    if scheme in ("abfs", "abfss"):
        return {f"spark.hadoop.fs.azure.account.key.{account}.dfs.core.windows.net": account_key} if account and account_key else {}
    if scheme in ("file", "hdfs", "viewfs"):
        return {}
    raise ConfigError(f"no settings for {scheme}")


def use_filesystem(spark: SparkSession, url: str, **settings: str) -> None:
    """Make the settings of a path's scheme those of the running session's Hadoop file systems, for tables there."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in filesystem_conf(url, **settings).items():
        conf.set(k.removeprefix("spark.hadoop."), v)
