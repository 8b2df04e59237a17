"""Small files and cut lineage through Spark's own file systems, never through local paths.

``Folder`` reads and writes text objects with Hadoop's file system of the folder's URI, so that
ledgers and pointers live wherever the data do.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sluice.errors import SluiceError


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there; a folder is set only if there is none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise SluiceError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or tempfile.mkdtemp(prefix="sluice-")).rstrip("/")


class Folder:
    """A folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        self.write_bytes(name, text.encode(), overwrite)

    def write_bytes(self, name: str, data: bytes, overwrite: bool = False) -> None:
        """Publish a whole object under a name: a temporary one is renamed, so readers see all or nothing."""
        part = self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/"))
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        final = self._at(name)
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(part, final, how)

    def list(self, name: str = "") -> list[tuple[str, int, int, bool]]:
        """(name, bytes, change time in ms, is a folder) of what lies in a folder, by name."""
        at = self._at(name)
        if not self._fs.exists(at):
            return []
        found = [(s.getPath().getName(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in self._fs.listStatus(at)]
        return sorted(found)

    def glob(self, pattern: str) -> list[tuple[str, int, int]]:
        """(path, bytes, change time in ms) of the files that a pattern under the folder names, by path."""
        found = self._fs.globStatus(self._at(pattern)) or []
        return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found if not s.isDirectory())

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
