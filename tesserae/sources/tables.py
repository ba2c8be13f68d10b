"""Table scans for CPU-bound work."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt out over all cores if it has fewer files than there are cores (a wide scan is left alone)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    # files count, not splits: a file of one row group gives its rows to one split, however many there are
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def folders(spark: SparkSession, path: str, files: bool = False) -> list[str]:
    """Names of the folders (or files) in a folder of any store that Spark reads; none if it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at) if f.isFile() == files] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all metadata versions of a cache, whole ones or not."""
    return [int(v[1:]) for v in folders(spark, f"{path.rstrip('/')}/meta") if v[:1] == "v" and v[1:].isdigit()]


def publish(spark: SparkSession, path: str, row: tuple, schema) -> None:
    """Write the next version of a cache's metadata; Spark's commit file makes it count."""
    last = versions(spark, path)
    spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/meta/v{max(last, default=0) + 1}")
    for v in sorted(last)[:-1]:  # the one before stays for readers that have just taken it
        remove(spark, f"{path}/meta/v{v}")


def newest(spark: SparkSession, path: str, schema) -> dict:
    """The last whole version of a cache's metadata."""
    at = path.rstrip("/")
    for v in sorted(versions(spark, at), reverse=True):
        if "_SUCCESS" in folders(spark, f"{at}/meta/v{v}", files=True):
            return spark.read.schema(schema).parquet(f"{at}/meta/v{v}").first().asDict()
    raise FileNotFoundError(f"no cache at {at}")


def sweep(spark: SparkSession, path: str, commits: list[str]) -> None:
    """Remove the data of commits that no longer count."""
    for old in folders(spark, f"{path}/data"):
        if old not in [f"commit={c}" for c in commits]:
            remove(spark, f"{path}/data/{old}")


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one serves a session in one process; on a cluster, whose machines don't share it, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return at


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir (a temporary one only where none is set): every later use sees the same rows in the same partitions."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)
