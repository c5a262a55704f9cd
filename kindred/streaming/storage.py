"""Where a stored index keeps its commits: the interface, its form on Spark's file systems, and the checks that any form must pass."""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import SparkSession

from ..errors import StorageError


class Storage(Protocol):
    """Small files and folders by path.  Rows are written and read by Spark itself, so paths must be such that Spark knows them."""

    def exists(self, path: str) -> bool: ...

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""

    def create(self, path: str, text: str) -> None:
        """Write a file that must not exist: of several writers one succeeds, and the others get a StorageError."""

    def read(self, path: str) -> str: ...

    def delete(self, path: str) -> None:
        """Delete a file, or a folder and all in it; a path that isn't there is passed over."""

    def size(self, path: str) -> int:
        """Bytes of a file or folder."""

    def modified(self, path: str) -> float:
        """Seconds of the last change since 1970."""


class HadoopStorage:
    """Any file system that Spark can reach.  Exclusive creation is as atomic as the file system makes it: HDFS and local
    ones do, and object stores may not, where a store with locks of its own can be given instead."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def create(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001  the file system says that it exists
            raise StorageError(f"{path} was written by another writer") from e
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def modified(self, path: str) -> float:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000


def conformance(storage: Storage, folder: str) -> list[str]:
    """The rules that a storage breaks, tried in a folder of their own; none for one that an index can rely on."""
    base, broken = f"{folder}/conformance-{uuid.uuid4().hex}", []

    def rule(name: str, holds: bool) -> None:
        if not holds:
            broken.append(name)

    rule("a missing folder has no names", storage.names(base) == [] and not storage.exists(base))
    storage.create(f"{base}/b", "two\nlines")
    storage.create(f"{base}/a", "é")
    rule("files exist once created", storage.exists(f"{base}/a") and storage.names(base) == ["a", "b"])
    rule("texts are read as written", (storage.read(f"{base}/b"), storage.read(f"{base}/a")) == ("two\nlines", "é"))
    try:
        storage.create(f"{base}/a", "again")
        rule("creation is exclusive", False)
    except StorageError:
        rule("a refused creation changes nothing", storage.read(f"{base}/a") == "é")
    rule("sizes are in bytes", storage.size(f"{base}/b") == 9 and storage.size(base) >= 11)
    rule("changes have a time", storage.modified(f"{base}/a") > 1e9)
    storage.delete(f"{base}/a")
    rule("deleted files are gone", storage.names(base) == ["b"])
    storage.delete(f"{base}/a")
    storage.delete(base)
    rule("folders go with all in them", not storage.exists(base) and storage.names(base) == [])
    return broken
