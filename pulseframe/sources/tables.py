"""Feature tables and caches: scans, versioned unions, memoised results, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; computed and written first if absent or forced."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def union_tables(frames: list[DataFrame], source: str | None = None) -> DataFrame:
    """Rows of all tables; columns that one lacks are null. ``source`` adds the number of the table."""
    frames = [f.withColumn(source, F.lit(i)) for i, f in enumerate(frames)] if source else frames
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole


def load_chunked(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Parquet chunks ``<prefix>_<n>`` of a folder with their number, in one scan."""
    df = spark.read.parquet(f"{folder}/{prefix}_*").withColumn("_file", F.input_file_name())
    return df.withColumn("chunk_no", F.regexp_extract("_file", rf"{prefix}_(\d+)", 1).cast("int")).drop("_file")


def merged_dataset(cells: DataFrame, features: DataFrame, morphology: DataFrame | None, key: str) -> DataFrame:
    """Cells with their features and, if given, morphology; cells without keep nulls."""
    out = cells.join(features, key, "left")
    return out.join(morphology, key, "left") if morphology is not None else out


def select_sweeps(sweeps: DataFrame, stimuli: list[str] | None = None, spiking: bool = False) -> DataFrame:
    """Sweeps of named stimuli, or those with spikes, by sweep number."""
    s = sweeps.filter(F.col("stimulus_name").isin(stimuli)) if stimuli else sweeps
    s = s.filter("num_spikes > 0") if spiking else s
    return s.orderBy("sweep_number")


def scale_traces(df: DataFrame, column: str, factor: float, index_range: tuple[int, int] | None = None) -> DataFrame:
    """Units of an array column converted (V to mV: 1e3) and the trace cut to [from, to]."""
    a = F.transform(column, lambda x: x * factor)
    a = F.slice(a, index_range[0] + 1, index_range[1] - index_range[0] + 1) if index_range else a
    return df.withColumn(column, a)


def save(df: DataFrame, path: str, partition_by: list[str] | None = None, buckets: tuple[int, str] | None = None, name: str | None = None) -> None:
    """Parquet sink, partitioned; with ``buckets`` (number, column) and ``name`` a bucketed table for co-located joins."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    if buckets and name:
        w.bucketBy(buckets[0], buckets[1]).sortBy(buckets[1]).option("path", path).saveAsTable(name)
    else:
        w.parquet(path)
