"""Cutting lineage through tables in the shared folder, which outlive a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this driver, removed when it ends.
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode, where the setting may be absent."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="quire-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return a scan of it.

    Later branches of a plan read the written columns instead of computing them again, and a lost
    executor costs a re-read, not a re-computation. An empty df keeps its schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as the cluster has cores or the session asks for, by key.

    For work that costs far more than its input's bytes suggest, which adaptive execution would pack into few tasks.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are removed at its end; results must have been used by then."""
    before = len(_written)
    try:
        yield
    finally:
        release(before)


def release(keep: int = 0) -> None:
    """Remove the tables written so far but for the first `keep`; results that still read them become invalid."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            pass


atexit.register(release)
