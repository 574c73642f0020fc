"""Small files in any store that Spark reaches, from the driver: listing, whole reads, and writes that appear at once or not at all."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local one if driver and executors are one process, and an error otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="strata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strata-{uuid.uuid4().hex}"


def write_blobs(rows: DataFrame, data: Column, end: str, path: str) -> str:
    """One file for each row of binary ``data``, followed by ``end``; gives the folder.

    Spark's text writer stores bytes as they are and commits files through the output committer, so this works in any store that Spark
    can write and survives lost executors. It ends lines, so that ``end`` has to be what such a file may end with.
    """
    rows.select(data.cast("string").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", 1).text(path)
    return path


class Files:
    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.base = self._path(base)
        self.fs = self.base.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.base).toString().rstrip("/")

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        path = self._path(self.root, folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> bytes | None:
        path = self._path(self.root, name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Writes a file that isn't there yet; False if it is. Content is complete before the name appears, and of writers at the same time one succeeds."""
        path, draft = self._path(self.root, name), self._path(self.root, f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        try:
            return self._name(draft, path)
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)

    def _name(self, draft, path) -> bool:
        """Gives the draft its name, unless something has it: a hard link on a local disk, and a rename that never replaces anywhere else."""
        if path.toUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), path.toUri().getPath())
                return True
            except FileExistsError:
                return False
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        never_replace = self.gateway.new_array(kind, 1)
        never_replace[0] = kind.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf).rename(draft, path, never_replace)
            return True
        except Exception:
            if self.fs.exists(path):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.root, name), True)
