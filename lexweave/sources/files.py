"""Folders and small files on any file system that the session's Hadoop client knows, local or shared."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


class Files:
    """The few operations on a folder and the small files in it that sources and sinks need."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, old: str, new: str) -> None:
        """Renames a file over what is there, in one step where the file system has it."""
        mode = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri())
        options = self.jvm.java.lang.reflect.Array.newInstance(mode.OVERWRITE.getClass(), 1)
        options[0] = mode.OVERWRITE
        context.rename(self.path(old), self.path(new), options)

    def folders(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path("")) if f.isDirectory()] if self.exists("") else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A small file, complete before it takes its name."""
        stream = self.fs.create(self.path(f".{name}.new"), True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        self.move(f".{name}.new", name)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, null where there is none."""
    folder, _, name = path.rpartition("/")
    files = Files(spark, folder or ".")
    return files.read(name) if files.exists(name) else None


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Writes a small text file, which is complete before it takes its name."""
    folder, _, name = path.rpartition("/")
    Files(spark, folder or ".").write(name, text)
    return path
