"""Intermediate results as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder of its own; on a cluster that would
    be a folder that executors don't see, so it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandgraph-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandgraph-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Lineage ends at the files, so a lost executor costs a reread, not a recomputation, and a result
    used many times is computed once.
    """
    spark = rows.sparkSession
    path = scratch(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Parts:
    """A result that grows by parts: each is written once, and all are read as one scan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.schema = spark, [], None

    def add(self, rows: DataFrame) -> DataFrame:
        """Write rows as a new part and read that part back."""
        path = scratch(self.spark)
        rows.write.parquet(path)
        self.paths.append(path)
        self.schema = rows.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored; frames that still read it are no more of use."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
