"""Small documents on any Hadoop file system: read, put in place atomically, claimed once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Documents below a folder. What is written goes to a name of its own first and is renamed into place,
    so that a reader sees the old document or the new one, whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = folder.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self, name: str) -> bytes | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def _written(self, data: bytes):
        tmp = self.path(f".writing-{uuid.uuid4().hex}")
        stream = self.fs.create(tmp, False)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        return tmp

    def _rename(self, tmp, name: str, how: str) -> None:
        kinds = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getClass(), 1)
        options[0] = getattr(kinds, how)
        self.context.mkdir(self.path(name).getParent(), None, True)
        self.context.rename(tmp, self.path(name), options)

    def put(self, name: str, data: bytes) -> None:
        """In place of what was there."""
        self._rename(self._written(data), name, "OVERWRITE")

    def claim(self, name: str, data: bytes) -> bool:
        """Whether the name was free; of several claimants one gets it, where renames are atomic."""
        tmp = self._written(data)
        try:
            self._rename(tmp, name, "NONE")
            return True
        except Exception as e:
            self.fs.delete(tmp, False)
            if self.fs.exists(self.path(name)):
                return False
            raise e

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(n for f in self.fs.listStatus(self.path(folder)) if not (n := f.getPath().getName()).startswith("."))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), False)
