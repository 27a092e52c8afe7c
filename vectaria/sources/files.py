"""Small files beside the tables, through Hadoop's file systems, so that any root works."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..types import Conflict, StorageError


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, path: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def fs(self, path: str) -> Any:
        return self.path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self.fs(path).exists(self.path(path))

    def mkdirs(self, path: str) -> None:
        self.fs(path).mkdirs(self.path(path))

    def delete(self, path: str) -> bool:
        return self.fs(path).delete(self.path(path), True)

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs(path).listStatus(self.path(path)) if s.isDirectory())

    def read_json(self, path: str) -> Any:
        stream = self.fs(path).open(self.path(path))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as e:
            raise StorageError(f"{path} is not JSON") from e

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs(path).listStatus(self.path(path)) if s.isFile())

    def write_json(self, path: str, x: Any, once: bool = False) -> None:
        """Written aside and renamed over the old one: readers see either, never a part.  With `once` an
        existing file is an error and stays."""
        aside = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs(aside).create(self.path(aside), True)
        try:
            stream.write(bytearray(json.dumps(x, indent=1), "utf-8"))
        finally:
            stream.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        self.jvm.java.lang.reflect.Array.set(options, 0, kind.NONE if once else kind.OVERWRITE)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs(path).getUri(), self.conf)
        try:
            context.rename(self.path(aside), self.path(path), options)
        except Py4JJavaError as e:
            self.delete(aside)
            if once and self.exists(path):
                raise Conflict("another writer came first") from e
            raise
