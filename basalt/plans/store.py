"""Tables between the rounds of an iterative plan."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. A local session may lack the setting, a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="basalt-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/basalt-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to a new path and read back. Nothing asks for a mark there, and each mark is two files that the driver makes."""
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    return written(df, shared_path(df.sparkSession))


class Rounds:
    """The rows of all rounds of an iteration: each round is written once, and all of them read as one table."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema, self.path = like.sparkSession, like.schema, shared_path(like.sparkSession)
        self.paths: list[str] = []

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes a round and returns it."""
        path = f"{self.path}/{len(self.paths)}"
        round = written(rows, path)
        self.paths.append(path)
        return round

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


class Versions:
    """A table in a folder that all executors share, as numbered versions that are read together.

    A version counts once its job has ended (its mark is there), so one that a lost job left behind is never read, and is written over.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._at = spark._jvm.org.apache.hadoop.fs.Path

    def numbers(self) -> list[int]:
        top = self._at(self.path)
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(top):
            return []
        found = ((re.fullmatch(r"v(\d+)", s.getPath().getName()), s.getPath()) for s in system.listStatus(top))
        return sorted(int(m[1]) for m, at in found if m and system.exists(self._at(at, "_SUCCESS")))

    def read(self) -> DataFrame:
        """All versions that there are now."""
        paths = [f"{self.path}/v{n}" for n in self.numbers()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame) -> None:
        """Writes a version."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v{max(self.numbers(), default=-1) + 1}")

    def replace(self, arranged: Callable[[DataFrame], DataFrame]) -> None:
        """One version, of all rows as arranged, in place of several. A reader that began before fails once its files are gone, and reads anew."""
        old = self.numbers()
        if len(old) > 1:
            self.add(arranged(self.read()))
            for n in old:
                gone = self._at(f"{self.path}/v{n}")
                gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
