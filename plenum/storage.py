"""The shared folder that cuts lineage: the session's spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names. Where none is named, a temporary one is set, but only if driver and executors are one process."""
    named = spark.conf.get(SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} names no folder, and executors do not see one of the driver")
        own = tempfile.mkdtemp(prefix="plenum-checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.conf.set(SETTING, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, bare: bool = False) -> DataFrame:
    """df, computed once and written to the shared folder: a lost executor costs no recomputation.

    bare: the planner's estimate of df's size is not carried along. A join's is the product of its sides', so over long
    loops it becomes a number of millions of digits, and planning takes longer than the work.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    if not bare:
        return out
    rows = out._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle of the session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
