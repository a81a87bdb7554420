"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_left: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where that is unset and all is one machine."""
    global _own_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="circlet-")
    return "file://" + _own_root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends, or by release()."""
    path = f"{shared_root(spark).rstrip('/')}/circlet/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM for a path in any store that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def release(path: str | None = None) -> None:
    """Deletes one staged path, or all."""
    for spark, p in [x for x in _left if path in (None, x[1])]:
        try:
            fs, hp = hadoop_path(spark, p)
            fs.delete(hp, True)
        except Exception:  # the JVM may be gone at exit; the folder is scratch
            pass
        _left.remove((spark, p))


atexit.register(release)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor repeats only what comes after, and a join on what is read
    sees plain exchanges on both sides, which adaptive execution can split.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_stage(*staged: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    for df in staged:
        release(df.staged_at)
