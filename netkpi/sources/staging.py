"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.conf.get("spark.master", "").startswith("local"):
        return tempfile.mkdtemp(prefix="netkpi-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")


def _file_system(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    system, done = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(done)


class Stage:
    """Parquet tables that live as long as the ``with`` block.

    A written table cuts the lineage like a checkpoint does, but keeps columns apart, so later
    reads fetch only what they need. If the block fails, the tables stay, and the error says where:
    a stage of the same ``folder`` takes complete tables as they are and goes on from there.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/netkpi-{uuid.uuid4().hex}"
        self.taken: set[str] = set()  # names of tables that were there already

    @staticmethod
    def of_session(spark: SparkSession) -> Stage:
        """A stage whose tables outlive this call; they go when the driver's Python ends."""
        stage = Stage(spark)
        system, path = _file_system(spark, stage.folder)

        def drop() -> None:
            try:
                system.delete(path, True)
            except Exception:  # the session's JVM has gone before
                pass

        atexit.register(drop)
        return stage

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, kind, error, _) -> None:
        if error is None:
            self.drop()
        else:
            error.add_note(f"staged tables are kept in {self.folder}")

    def table(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        path = f"{self.folder}/{name}"
        if is_complete(self.spark, path):
            self.taken.add(name)
        else:
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        system, path = _file_system(self.spark, self.folder)
        system.delete(path, True)
