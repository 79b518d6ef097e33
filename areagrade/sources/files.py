"""Folders of the cluster's file system, through Spark's own client for it."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A path on whatever file system it names; nothing is read or written but names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def child(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._files.exists(self._at)

    def names(self) -> list[str]:
        """What lies in the folder, hidden names too; nothing if there is no folder."""
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at)) if self.exists() else []

    def make(self) -> None:
        self._files.mkdirs(self._at)

    def delete(self) -> None:
        """The folder with all in it; one that is not there is no fault."""
        self._files.delete(self._at, True)

    def move_to(self, other: Folder) -> None:
        """Under a new name on the same file system, at which nothing may be."""
        if other.exists():
            raise FileExistsError(other.path)
        if not self._files.rename(self._at, other._at):
            raise OSError(f"{self.path} cannot be renamed to {other.path}")

    def write_text(self, text: str) -> None:
        """A small file that is there whole or not at all: written under another name, then renamed."""
        draft = Folder(self.spark, f"{self.path}.draft")
        stream = self._files.create(draft._at, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        draft.move_to(self)

    def read_text(self) -> str:
        stream = self._files.open(self._at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
