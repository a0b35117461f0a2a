"""Files of a table's folder on any file system that Spark reads: listing, reading, exclusive creation, removal."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from tidefold.errors import ConfigError, ConflictError, StorageError

#: Hadoop file systems whose rename onto a present file fails as one step.
ATOMIC_RENAME = ("hdfs", "viewfs", "webhdfs", "ofs")


def plain_path(path: str) -> str:
    """A local path or URI in one spelling; others as they are."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


@dataclass(frozen=True)
class Listed:
    path: str
    size: int
    changed_ms: int


@dataclass
class Store:
    spark: SparkSession
    root: str
    #: For stores without an atomic rename: create a file unless it is there, and say whether it was created.
    put_if_absent: Callable[[str, bytes], bool] | None = None

    def __post_init__(self) -> None:
        self.root = plain_path(self.root)
        self.scheme = self.root.partition("://")[0] if "://" in self.root else "file"
        if self.scheme != "file" and self.scheme not in ATOMIC_RENAME and self.put_if_absent is None:
            raise ConfigError(f"commits on {self.scheme} need put_if_absent")

    def _path(self, path: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):  # noqa: ANN202
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return os.path.exists(path) if self.scheme == "file" else self._fs(path).exists(self._path(path))

    def create(self, path: str, data: bytes) -> None:
        """Whole or not at all; a ConflictError if the file is there."""
        if self.put_if_absent is not None:
            if not self.put_if_absent(path, data):
                raise ConflictError(f"{path} exists")
            return
        there, _, name = path.rpartition("/")
        draft = f"{there}/.{name}.{uuid.uuid4().hex}"
        if self.scheme == "file":
            os.makedirs(there, exist_ok=True)
            Path(draft).write_bytes(data)
            try:
                os.link(draft, path)
            except FileExistsError:
                raise ConflictError(f"{path} exists") from None
            finally:
                os.unlink(draft)
            return
        jvm, fs = self.spark.sparkContext._jvm, self._fs(path)
        out = fs.create(self._path(draft), False)
        out.write(bytearray(data))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), fs.getConf()).rename(self._path(draft), self._path(path), none)
        except Exception as e:  # noqa: BLE001  the gateway wraps all of them
            fs.delete(self._path(draft), False)
            if fs.exists(self._path(path)):
                raise ConflictError(f"{path} exists") from None
            raise StorageError(str(e)) from None

    def read(self, path: str) -> bytes:
        if self.scheme == "file":
            return Path(path).read_bytes()
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def list(self, folder: str) -> Iterator[Listed]:
        """All files below a folder, but for hidden ones."""
        if self.scheme == "file":
            for at, folders, names in os.walk(folder):
                folders[:] = [f for f in folders if not f.startswith(".")]
                for n in names:
                    if not n.startswith((".", "_SUCCESS")):
                        s = os.stat(f"{at}/{n}")
                        yield Listed(f"{at}/{n}", s.st_size, int(s.st_mtime * 1000))
        elif self.exists(folder):
            found = self._fs(folder).listFiles(self._path(folder), True)
            while found.hasNext():
                f = found.next()
                name = f.getPath().getName()
                if not name.startswith((".", "_SUCCESS")):
                    yield Listed(f.getPath().toString(), f.getLen(), f.getModificationTime())

    def names(self, folder: str) -> list[str]:
        """What lies directly in a folder."""
        if self.scheme == "file":
            return sorted(n for n in os.listdir(folder) if not n.startswith(".")) if os.path.isdir(folder) else []
        if not self.exists(folder):
            return []
        return sorted(n for f in self._fs(folder).listStatus(self._path(folder)) if not (n := f.getPath().getName()).startswith("."))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
