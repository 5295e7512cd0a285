"""Reliable scratch space for cutting lineage.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, the folder that all
executors of a cluster share, so a lost executor never takes an intermediate result with it.
Only where that setting is absent (unit tests, a laptop session) a temporary folder is used.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="pulseframe-")
    return _FALLBACK[app]


def _forget(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder, deleted when the Python driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and return it as a table without lineage.

    The folder is deleted when the Python driver ends.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
