"""File sources and sinks: Parquet, JSON lines and documents, CSV, Markdown and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def discover(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, sha256) of the files below a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """JSON under a declared schema; a record that doesn't parse is a row of nulls, never an abort."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def read_versioned(spark: SparkSession, path: str, schema: StructType | str, column: str, version: str) -> DataFrame:
    """JSON whose format version is `version`; any other version fails the read where it is met."""
    rows = read_json(spark, path, schema)
    ok = F.coalesce(F.col(column) == version, F.lit(False))
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("unsupported format version: "), F.coalesce(column, F.lit("none"))))))


def write_partitioned(df: DataFrame, path: str, partition: str) -> None:
    """Parquet by partition; only the partitions in df are replaced."""
    df.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_postings(df: DataFrame, table: str, buckets: int) -> None:
    """A table bucketed and sorted by term, so that joins on term need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_markdown(df: DataFrame, path: str, group: str, text: str) -> None:
    """One line a row below a heading for each group, as text files in order of group."""
    order = F.struct(F.lit(1).alias("n"), F.col(text).alias("t"))
    body = df.groupBy(group).agg(F.array_sort(F.collect_list(order))["t"].alias("lines"))
    lines = F.concat(F.lit("## "), F.coalesce(group, F.lit("none")), F.lit("\n\n- "), F.array_join("lines", "\n- "), F.lit("\n"))
    body.orderBy(group).select(lines.alias("value")).write.mode("overwrite").text(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(entry_no, sha256, path, index_status, title, author) of a JSON document with a list `documents`, in file order."""
    schema = "documents array<struct<sha256: string, path: string, index_status: string, title: string, author: string>>"
    return read_json(spark, path, schema, multi_line=True).select(F.posexplode("documents").alias("entry_no", "e")).select("entry_no", "e.*")


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table each for nodes, edges, evidence and state."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def write_report(df: DataFrame, folder: str, stamp: str) -> None:
    """A report as JSON lines, under its time stamp and as the latest; null fields are left out."""
    for name in (stamp, "latest"):
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def read_runs(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The records of all runs of a folder with the file each came from; records that don't parse are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(folder)
    return rows.withColumn("file", F.input_file_name())


def write_comparison(means: DataFrame, path: str, ks: tuple[int, ...]) -> None:
    """One line a run and mode: each metric at each cut-off, cut-offs in order, then mrr. means: run, mode, k, hit, recall, precision, ndcg, mrr."""
    at = lambda metric, k: F.max(F.when(F.col("k") == k, F.col(metric))).alias(f"{metric}@{k}")
    wide = means.groupBy("run", "mode").agg(*[at(m, k) for m in ("hit", "recall", "precision", "ndcg") for k in sorted(ks)], F.max("mrr").alias("mrr"))
    write_csv(wide.orderBy("run", "mode"), path)


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): every row as one JSON text; null fields are left out."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))
