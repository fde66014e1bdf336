"""Cutting long lineages on storage that every executor can reach."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used on a local master only, and removed at the end; on a
    cluster the absence is an error, since a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="siltflow-checkpoint-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there, with its partitions as they are."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Stored:
    """A table in the shared folder."""

    spark: SparkSession
    path: str
    schema: T.StructType

    @property
    def df(self) -> DataFrame:
        return read_all([self])

    def drop(self) -> None:
        """Delete the files; nothing that reads them may run later."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame) -> Stored:
    """Write ``df`` as a table of the shared folder.

    For loops: a checkpoint keeps the size estimate of its plan, which each join multiplies, until planning
    itself takes longest. A table read back has the size of its files. What is not dropped goes with the session at the latest,
    by ``clear`` or with the folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Stored(spark, path, df.schema)


def read_all(tables: Sequence[Stored]) -> DataFrame:
    """Rows of several tables of one schema as one scan."""
    return tables[0].spark.read.schema(tables[0].schema).parquet(*[t.path for t in tables])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to, as those of tables just stored; it only notices after a collection of the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``store`` has written; for the end of a job, once no result of it is read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/tables")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
