"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of documents that lie together in files; Spark's readers of the folder above pass it by.
PACKED = "_packed"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the warehouse, if that is in a store that all share, or a temporary folder for a local master, which is removed at the end."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and (sc.master.startswith("local[") or sc.master == "local"):
        base = getattr(shared_folder, "local", None)
        if not base:
            base = shared_folder.local = tempfile.mkdtemp(prefix="loomtext-")
            atexit.register(remove, spark, base)
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_loomtext"
    if not sc.master.startswith("local") and base.startswith("file:") and not sc.getConf().get("spark.checkpoint.dir"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, leads to anything."""
    where, fs = file_system(spark, path)
    return bool(fs.globStatus(where))


def within(spark: SparkSession, pattern: str) -> list[str]:
    """The folders in which what a pattern of paths leads to lies, one for each find."""
    where, fs = file_system(spark, pattern)
    return [found.getPath().getParent().toString() for found in fs.globStatus(where) or []]


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, leads to a file or to a folder with anything that Spark's readers see."""
    where, fs = file_system(spark, path)
    for found in fs.globStatus(where) or []:
        if not found.isDirectory():
            return True
        inside = fs.listStatusIterator(found.getPath())
        while inside.hasNext():
            if not inside.next().getPath().getName().startswith(("_", ".")):
                return True
    return False


def remove(spark: SparkSession, path: str) -> None:
    try:
        where, fs = file_system(spark, path)
        fs.delete(where, True)
    except Exception:  # the session may be gone; the folder is scratch
        pass


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/loomtext-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read back: nothing computes it again, and a lost executor costs nothing of it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A table of few splits, dealt out to all cores before anything is made of its rows: a small table is one split, however long what is made
    of it takes. by: its keys, no two rows alike; without them rows are sorted before they are dealt, in as few tasks as there are splits."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *by)


def once(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """The columns that are kept and those that are made, each of which is computed once a row: filters and later columns do not
    go below a generator, as they go below a projection, where each computes again what it reads."""
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(name) for name, c in made.items())))))
