"""Intermediate tables and archives in the shared folder the cluster names in spark.checkpoint.dir.

Executors write archive files under names of their own attempt and report them in index rows; only
files that the committed index names count, so a lost executor leaves at most an unused file.
"""

import os
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared root."""
    root = checkpoint_root(spark)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: cuts lineage, survives lost executors, is computed once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns, however they are called, go."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def filesystem(uri: str):
    """Arrow file system and path of a URI; called inside tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and "://" not in uri else uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """File name that no other task attempt uses."""
    ctx = TaskContext.get()
    return f"{prefix}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"


def partitions(spark: SparkSession) -> int:
    """Reduce-side parallelism the user has sized for the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*names: str) -> list[Column]:
    """Two columns __k1, __k2: a 128-bit digest of the named columns that is never null, so that windows and joins share a partitioning."""
    nulls = F.concat(*[F.col(n).isNull().cast("string") for n in names])
    return [F.xxhash64(*names, nulls).alias("__k1"), F.xxhash64(nulls, *reversed(names)).alias("__k2")]
