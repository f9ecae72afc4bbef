"""Session helpers: a local session for tests and benchmarks, shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "marketlab", memory: str = "8g") -> SparkSession:
    """A local[N] session with the settings the jobs are tested with."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # building column expressions is much faster without call-site capture
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: list[str] = []  # of a process whose master is this machine


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, which all executors must see: ``spark.checkpoint.dir``.

    Where it is unset, a local[N] session takes a folder of this machine, on which everything
    runs; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors "
                           "before the session starts")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _OWN[0]


_LOCAL = threading.local()  # streams run side by side: each thread cleans up its own


def _intermediates() -> list[str]:
    if not hasattr(_LOCAL, "paths"):
        _LOCAL.paths = []
    return _LOCAL.paths


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage with a columnar copy that outlives lost executors and keeps
    column pruning and filter pushdown for every later reader.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _intermediates().append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a folder on whatever file system it lives on."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it does not exist."""
    if not path_exists(spark, path):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted(f.getPath().getName() for f in found)


def make_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(f.getPath().toString() for f in found or [])


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the folders above the target are made, a target that is there is an error."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(make(target).getParent())
    if fs.exists(make(target)) or not fs.rename(make(source), make(target)):
        raise OSError(f"cannot move {source} to {target}")


def intermediates_mark() -> int:
    """Position in the list of intermediate tables, for ``discard_intermediates``."""
    return len(_intermediates())


def discard_intermediates(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``materialize`` wrote in this thread after the mark."""
    paths, n = _intermediates(), 0
    while len(paths) > since:
        n += bool(delete_path(spark, paths.pop()))
    return n


def settle(df: DataFrame, name: str, since: int) -> DataFrame:
    """Materialize a result and delete the intermediate tables it was made from (those after the mark)."""
    out = materialize(df, name)
    kept = _intermediates().pop()
    discard_intermediates(df.sparkSession, since)
    _intermediates().append(kept)
    return out
