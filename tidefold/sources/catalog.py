"""A catalog: a folder of namespaces, each a folder of tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from tidefold.errors import ConfigError, PlanningError
from tidefold.plans.cache import ManifestCache
from tidefold.plans.table import Table
from tidefold.sources.store import Store

NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_\-]*")


@dataclass
class Catalog:
    spark: SparkSession
    root: str
    cache: ManifestCache | None = None

    def _path(self, *names: str) -> str:
        names = tuple(part for n in names for part in n.split("."))
        for n in names:
            if not NAME.fullmatch(n):
                raise ConfigError(f"not a name: {n!r}")
        return "/".join([self.root.rstrip("/"), *names])

    def create_table(self, namespace: str, name: str, schema: StructType) -> Table:
        table = Table.create(self.spark, self._path(namespace, name), schema)
        table.cache = self.cache
        return table

    def load_table(self, namespace: str, name: str) -> Table:
        table = Table(self.spark, self._path(namespace, name), cache=self.cache)
        if not table.log.versions():
            raise PlanningError(f"no table {namespace}.{name}")
        return table

    def load(self, identifier: str) -> Table:
        """A table by its dotted name, one namespace at least."""
        namespace, _, name = identifier.rpartition(".")
        if not namespace:
            raise PlanningError(f"{identifier!r} names no namespace")
        return self.load_table(namespace, name)

    def list_tables(self, namespace: str) -> list[str]:
        store = Store(self.spark, self._path(namespace))
        return [n for n in store.names(store.root) if store.names(f"{store.root}/{n}/_log")]
