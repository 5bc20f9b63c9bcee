"""Folders that are replaced at once: readers see all old files or all new ones, and never none."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Published:
    """A folder whose contents are those that its pointer names.

    A new version is written to a folder of its own beside the old one. The pointer, one small file, is then replaced by a
    rename, which is the commit: until then, and if writing fails, readers find the old version. The version before the
    newest is kept, so that reads under way end well; older ones, and what failed writes left, go with the next publish.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _versions(self) -> list[str]:
        """The current version's name, and that of the one before; none before the first publish."""
        pointer = self._path("_current")
        if not self.files.exists(pointer):
            return []
        stream = self.files.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def current(self) -> str:
        """The folder to read."""
        if not (names := self._versions()):
            raise FileNotFoundError(f"nothing is published at {self.root}")
        return f"{self.root}/{names[0]}"

    def publish(self, write: Callable[[str], None]) -> str:
        """write(folder) makes the new version; it is there for readers once this returns its folder."""
        kept = self._versions()[:1]
        new = f"v-{uuid.uuid4().hex}"
        write(f"{self.root}/{new}")
        mark = self._path(f"_pointer-{new}")
        stream = self.files.create(mark, True)
        try:
            stream.write(" ".join([new, *kept]).encode())
        finally:
            stream.close()
        option = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf).rename(mark, self._path("_current"), options)
        for status in self.files.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith(("v-", "_pointer-")) and name not in (new, *kept):
                self.files.delete(status.getPath(), True)
        return f"{self.root}/{new}"
