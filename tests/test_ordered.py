import random

import pytest
from pyspark.sql import functions as F

from quire.plans.ordered import running

SCHEMA = "g string, o int, v int, n string"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in several partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def brute(rows):
    out, state = {}, {}
    for g, o, v, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        lag, last, total = state.get(g, (None, None, 0))
        last = v if v is not None else last
        total += v or 0
        out[g, o] = (lag, last, total)
        state[g] = (v, last, total)
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    v = F.col("v")
    return running(df, ["g"], ["o"], {"before": ("lag", v), "n": ("last", v), "total": ("sum", F.coalesce(v, F.lit(0)))})


def test_equals_a_single_pass(spark):
    rng = random.Random(1)
    # a hot group over all partitions, small ones, nulls, and a column whose name clashes
    rows = [("hot", i, rng.choice([None, None, i]), "x") for i in range(900)]
    rows += [(g, i, rng.choice([None, i + 1]), "x") for g in ("a", "b", "zz", None) for i in range(rng.randrange(1, 40))]
    got = {(r.g, r.o): (r.before, r.n, r.total) for r in run(spark, rows).collect()}
    assert got == brute(rows)


def test_a_hot_group_is_spread(spark):
    rows = [("hot", i, i, "x") for i in range(2000)]
    out = run(spark, rows)
    assert max(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) < 2000


def test_empty(spark):
    assert run(spark, []).count() == 0
