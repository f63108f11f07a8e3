"""Small files by Hadoop's file system, so that a store can live wherever Spark can read and write."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..errors import StoreIOError


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint setting, else a fresh local one, as in tests."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local["):
            raise StoreIOError("spark.checkpoint.dir isn't set; on a cluster it has to name a shared folder")
        where = tempfile.mkdtemp(prefix="tidemark-")
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def mkdirs(self, name: str = "") -> None:
        if not self._fs.mkdirs(self._path(name)):
            raise StoreIOError(f"can't create {self.root}/{name}")

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def sizes(self, name: str) -> dict[str, int]:
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(name))}

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()

    def create_new(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        try:
            self.write(name, text, overwrite=False)
            return True
        except Exception as e:
            if self.exists(name):
                return False
            raise StoreIOError(str(e)) from e

    def swap(self, source: str, target: str) -> None:
        """Atomic rename over ``target``."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        kinds[0] = rename.OVERWRITE
        context.rename(self._path(source), self._path(target), kinds)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
