"""Prefix sums and quotas over strata of any number: ranges are summed apart, then carried on from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlcurio.operators.shared import written


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the total of its expression over all rows before, in ``order``.

    Rows are dealt by ranges of ``order`` and written, so that a range stays what it is when lost tasks
    run again. Each range is scanned by itself; what lies before it comes from a table of one row a
    range, as many as shuffle partitions, whose window is the only one over all. ``order`` should tell
    rows apart: equal ones fall into one range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.columns
    placed = df.select(*kept, *[c.alias(f"_sum_{name}") for name, c in sums.items()]).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    placed = written(placed, "ranges")
    up_to_here = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(*[F.sum(f"_sum_{name}").alias(f"_of_{name}") for name in sums])
    ranges = up_to_here.partitionBy(F.lit(0)).orderBy("_range")
    before = totals.select("_range", *[F.coalesce(F.sum(f"_of_{name}").over(ranges), F.lit(0)).alias(f"_before_{name}") for name in sums])
    own = up_to_here.partitionBy("_range").orderBy(*order)
    found = placed.join(F.broadcast(before), "_range")
    return found.select(*kept, *[(F.col(f"_before_{name}") + F.coalesce(F.sum(f"_sum_{name}").over(own), F.lit(0))).alias(name) for name in sums])


def _named(by: list[str], first: Column) -> list[Column]:
    return [first, *[F.col(c).asc_nulls_first() for c in by]]


def proportional_quota(counts: DataFrame, by: list[str], target: int, least: int = 1) -> DataFrame:
    """:func:`sampling.proportional_quota` for strata too many for one task: the same quotas from scans of ranges."""
    counts = written(counts.select(*by, "cnt"), "strata")
    total = counts.agg(F.sum("cnt")).first()[0] or 0
    share = F.bround(F.try_divide(F.col("cnt") * F.lit(target), F.lit(total)), 0)
    df = counts.withColumn("_a", F.least(F.greatest(F.lit(least), share), F.col("cnt")).cast("long"))
    need = target - (df.agg(F.sum("_a")).first()[0] or 0)
    room, slack = F.col("cnt") - F.col("_a"), F.greatest(F.col("_a") - least, F.lit(0))
    pour, order = (room, F.desc("cnt")) if need > 0 else (slack, F.asc("cnt"))
    if need:
        df = prefix_sums(df, _named(by, order), {"_before": pour})
        moved = F.least(F.greatest(F.lit(abs(need)) - F.col("_before"), F.lit(0)), pour)
        df = df.withColumn("_a", F.col("_a") + moved if need > 0 else F.col("_a") - moved)
    return df.select(*by, "cnt", F.col("_a").cast("long").alias("quota"))


def uniform_quota(counts: DataFrame, by: list[str], target: int) -> DataFrame:
    """:func:`sampling.uniform_quota` for strata too many for one task."""
    counts = written(counts.select(*by, "cnt"), "strata")
    n, smallest = counts.agg(F.count("*"), F.min("cnt")).first()
    if not n:
        return counts.withColumn("quota", F.lit(0).cast("long"))
    even = target // n
    if even > smallest:
        return counts.withColumn("quota", F.lit(smallest).cast("long"))
    ranked = prefix_sums(counts, _named(by, F.desc("cnt")), {"_rank": F.lit(1)})
    more = (F.col("_rank") < target % n) & (F.lit(even) < F.col("cnt"))
    return ranked.select(*by, "cnt", (F.lit(even) + F.when(more, 1).otherwise(0)).cast("long").alias("quota"))


def largest_remainder_quota(counts: DataFrame, by: list[str], target: int) -> DataFrame:
    """:func:`sampling.largest_remainder_quota` for strata too many for one task."""
    counts = written(counts.select(*by, "cnt"), "strata")
    total = counts.agg(F.sum("cnt")).first()[0] or 1
    df = counts.withColumn("_floor", F.floor(F.lit(target) * F.col("cnt") / total)).withColumn("_rest", (F.lit(target) * F.col("cnt")) % total)
    left = min(target, total) - (df.agg(F.sum("_floor")).first()[0] or 0)
    ranked = prefix_sums(df, _named(by, F.desc("_rest")), {"_rank": F.lit(1)})
    return ranked.select(*by, "cnt", F.least(F.col("_floor") + F.when(F.col("_rank") < left, 1).otherwise(0), F.col("cnt")).cast("long").alias("quota"))
