"""Numbered documents in a folder, each written at most once: what commits and revisions are made of."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Old documents are kept for readers that are still at work with them.
KEPT = 50


class LocalFolder:
    """A folder of the driver; a hard link makes a file only where there is none."""

    def __init__(self, path: str):
        self.path = Path(path)

    def names(self) -> list[str]:
        return [p.name for p in self.path.iterdir()] if self.path.is_dir() else []

    def read(self, name: str) -> str:
        return (self.path / name).read_text(encoding="utf-8")

    def put(self, name: str, text: str) -> bool:
        self.path.mkdir(parents=True, exist_ok=True)
        draft = self.path / f".{uuid.uuid4().hex}"
        draft.write_text(text, encoding="utf-8")
        try:
            os.link(draft, self.path / name)
            return True
        except FileExistsError:
            return False
        finally:
            draft.unlink()

    def delete(self, name: str) -> None:
        (self.path / name).unlink(missing_ok=True)


class SharedFolder:
    """A folder of a Hadoop file system; needs one that renames in one step and never over a file, as HDFS does."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, jvm = spark, spark._jvm
        self.jvm, self.conf = jvm, spark._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        from py4j.protocol import Py4JJavaError

        self.fs.mkdirs(self.path)
        draft, target = self._at(f".{uuid.uuid4().hex}"), self._at(name)
        out = self.fs.create(draft, False)
        out.write(text.encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, target, options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        finally:
            self.fs.delete(draft, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), False)


def folder(path: str, spark: SparkSession | None = None) -> LocalFolder | SharedFolder:
    """The folder at ``path``; without a session, or on a file system of scheme ``file``, a local one."""
    if spark is None:
        return LocalFolder(path.removeprefix("file://"))
    shared = SharedFolder(spark, path)
    return LocalFolder(shared.path.toUri().getPath()) if shared.fs.getScheme() == "file" else shared


class Numbered:
    """Documents 1, 2, 3 and so on; the newest counts."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.folder = folder(path, spark)

    def _numbers(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.folder.names() if n.endswith(".json") and not n.startswith("."))

    @staticmethod
    def _name(number: int) -> str:
        return f"{number:020d}.json"

    def newest(self) -> tuple[int, str] | None:
        numbers = self._numbers()
        return (numbers[-1], self.folder.read(self._name(numbers[-1]))) if numbers else None

    def put(self, number: int, text: str) -> bool:
        """False if there is, or was, a document of this number already."""
        if not self.folder.put(self._name(number), text):
            return False
        numbers = self._numbers()
        if numbers[-1] > number:  # the slot was free only because the old document is deleted by now
            self.folder.delete(self._name(number))
            return False
        for old in numbers[:-KEPT]:
            self.folder.delete(self._name(old))
        return True
