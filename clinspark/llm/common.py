"""Shared plumbing: code shipping, checkpoint tables and column helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.sources.store import shared_dir

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, whatever their own Python path holds."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        archive = os.path.join(tempfile.mkdtemp(prefix="clinspark-"), "clinspark_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("clinspark", os.path.relpath(path, root)))
        sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that was written by :func:`written`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session may be gone at exit; its folder then goes with it
        pass


def written(spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder, return it as read back and its path.

    Unlike a local checkpoint the files outlive the loss of any executor.
    """
    path = f"{shared_dir(spark)}/clinspark-{name}-{uuid.uuid4().hex}"
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in fewer parts, for :func:`written` tables that are small next to what they were made of.

    Each file of a local store costs an executor a process or more, that of a part with a row as much as a full one. At most
    eight of the parts that a shuffle makes become one, so a task's share still falls as their number is raised.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add (names compare without case, as Spark does)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
