"""Scans over ranges give what one window over all gives; lines keep their numbers over splits."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sqlcurio.operators import sampling, scan
from sqlcurio.sources import readers


def rows(df):
    return sorted(map(tuple, df.select("a", "b", "cnt", "quota").collect()), key=repr)


@pytest.mark.parametrize("target", [0, 7, 150, 1100, 5000, 90_000])
def test_quotas_of_ranges_equal_those_of_one_window(spark, target):
    draw = random.Random(target)
    counts = spark.createDataFrame([(draw.choice([None, "x", "y"]), k, draw.choice([1, 1, 2, 9, 40])) for k in range(1000)], "a string, b long, cnt long").repartition(5)
    by = ["a", "b"]
    for name, options in (("proportional_quota", {"least": 1}), ("proportional_quota", {"least": 0}), ("uniform_quota", {}), ("largest_remainder_quota", {})):
        assert rows(getattr(scan, name)(counts, by, target, **options)) == rows(getattr(sampling, name)(counts, by, target, **options)), name
        assert getattr(scan, name)(counts.limit(0), by, target, **options).count() == 0


def test_a_million_strata_are_summed_in_many_tasks(spark):
    strata = spark.range(1_000_000).select(F.lit("x").alias("a"), F.col("id").alias("b"), (F.col("id") % 5 + 1).alias("cnt"))
    out = scan.proportional_quota(strata, ["a", "b"], 1_500_000)
    total = out.agg(F.sum("quota"), F.min(F.col("cnt") - F.col("quota")), F.count("*")).first()
    assert total[0] == 1_500_000 and total[1] >= 0 and total[2] == 1_000_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # of one row a range
    most = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert most < 600_000


def test_prefix_sums_of_ties_and_negatives(spark):
    df = spark.createDataFrame([(k % 3, k, (-1) ** k * k) for k in range(200)], "g long, k long, v long").repartition(7)
    order = [F.desc("g"), F.asc("k")]
    got = scan.prefix_sums(df, order, {"s": F.col("v"), "n": F.lit(1)})
    every = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(every), F.lit(0))).withColumn("n", F.count("*").over(every))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    text = [f"line {k} " + "é" * (k % 50) + "\r" * (k % 2) for k in range(3000)]
    (tmp_path / "one.jsonl").write_text("\n".join(text), newline="")
    (tmp_path / "two.jsonl").write_text("a\n\nb\n", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.numbered_lines(spark, str(tmp_path / "*.jsonl"))
        assert df.rdd.getNumPartitions() > 5
        assert [tuple(r) for r in df.orderBy("pos").collect()] == list(enumerate([*text, "a", "", "b"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
