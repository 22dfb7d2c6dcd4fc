"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir``; a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wirefold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` in the shared folder and reread it."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files of a folder, on any file system Spark knows; driver side."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path, spark._jvm
        self._system = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str = "") -> list[str]:
        """What a subfolder holds; nothing if it is absent."""
        at = self._at(sub)
        return sorted(s.getPath().getName() for s in self._system.listStatus(at)) if self._system.exists(at) else []

    def text(self, name: str) -> str:
        stream = self._system.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file under another name, then rename it: it is whole or absent."""
        part = f"{name}.{uuid.uuid4().hex}"
        out = self._system.create(self._at(part))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._system.rename(self._at(part), self._at(name)):
            self._system.delete(self._at(part), False)
            if not self._system.exists(self._at(name)):
                raise OSError(f"cannot write {self.path}/{name}")

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)
