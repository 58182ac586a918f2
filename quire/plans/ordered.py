"""Running values over long ordered groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import write_table


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with one column more for each of `values`: name -> (kind, value), along `order` within `group`.

    kind 'lag': the value of the row before, 'last': the last value that isn't null up to the row,
    'sum': the sum up to the row. Rows are range-partitioned by group and order and numbered by partition
    once, in a written table; windows stay within a partition, and what a group brings along from earlier
    partitions is joined from one row a partition. Ties in order have no defined sequence; null keys are a
    group. Columns of df with the names in `values` are replaced.
    """
    inner = {name: f"__v_{name}" for name in values}
    df = df.select(*[c for c in df.columns if c not in values], *[v.alias(inner[k]) for k, (_, v) in values.items()])
    keys = [F.col(c) for c in group + order]
    placed = write_table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "ordered")

    # what the last group of each partition hands on
    g = F.struct(*group)
    at = F.struct(*order)
    take = {
        "lag": lambda c: F.max_by(F.struct(c), at),
        "last": lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.struct(c)), F.when(F.col(c).isNotNull(), at)),
        "sum": lambda c: F.struct(F.sum(c).alias(c)),
    }
    ends = placed.groupBy("__part", g.alias("__g")).agg(*[take[kind](inner[k]).alias(k) for k, (kind, _) in values.items()])
    ends = ends.groupBy("__part").agg(F.max_by(F.struct("__g", *values), "__g").alias("x")).select("__part", "x.*")
    # one row a partition: the chain of partitions is short
    before = Window.partitionBy("__g").orderBy("__part")
    chain = {
        "lag": lambda k: F.col(k)[inner[k]],
        "last": lambda k: F.last(F.col(k)[inner[k]], ignorenulls=True).over(before),
        "sum": lambda k: F.sum(F.col(k)[inner[k]]).over(before),
    }
    handed = ends.select("__part", "__g", *[chain[kind](k).alias(k) for k, (kind, _) in values.items()])
    # to the later partitions that begin with this group, up to the next that hands it on
    handed = handed.select(F.col("__part").alias("__from"), F.lead("__part").over(before).alias("__to"), F.col("__g").alias("__h"), F.struct(*values).alias("__c"))
    firsts = placed.groupBy("__part").agg(F.min(g).alias("__g"))
    later = F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__part") > F.col("__from")) & (F.col("__to").isNull() | (F.col("__part") <= F.col("__to")))
    carried = firsts.join(handed, later).select(F.col("__part").alias("__p"), "__h", "__c")
    joined = placed.join(carried, (F.col("__part") == F.col("__p")) & g.eqNullSafe(F.col("__h")), "left")
    w = Window.partitionBy("__part", *group).orderBy(*order)
    number = F.row_number().over(w)
    whole = {
        "lag": lambda k: F.when(number == 1, F.col("__c")[k]).otherwise(F.lag(inner[k]).over(w)),
        "last": lambda k: F.coalesce(F.last(inner[k], ignorenulls=True).over(w), F.col("__c")[k]),
        "sum": lambda k: F.sum(inner[k]).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.col("__c")[k], F.lit(0)),
    }
    return joined.select(*[c for c in df.columns if c not in inner.values()], *[whole[kind](k).alias(k) for k, (kind, _) in values.items()])
