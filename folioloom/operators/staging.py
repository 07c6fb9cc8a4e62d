"""Tables that a job writes between its steps, and folders with a pointer to what is valid in them."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. Where it is unset a session with the master
    local, which is one process, gets a temporary folder; on any cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pointer:
    """Which tables below a folder are valid: small JSON files, numbered, of which the last one counts.

    A state is written under a name that no reader looks at and renamed, so a reader sees the state before or after, and
    tables that a killed job has left are in none. One job writes at a time: a second one that tries to publish the
    same number gets an error.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self) -> list[str]:
        at = self._path("_valid")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json")) if self._fs.exists(at) else []

    def read(self) -> dict | None:
        """The last state with its number, or None."""
        names = self._names()
        if not names:
            return None
        stream = self._fs.open(self._path(f"_valid/{names[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": int(names[-1][:12])}
        finally:
            stream.close()

    def publish(self, state: dict, number: int) -> None:
        """Make state the valid one, as the number-th."""
        final, draft = self._path(f"_valid/{number:012d}.json"), self._path(f"_valid/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "number"}).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise FileExistsError(f"{self.root}: another job has published state {number}")
        for name in self._names()[:-8]:
            self._fs.delete(self._path(f"_valid/{name}"), False)

    def delete(self, *paths: str) -> None:
        for path in paths:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
