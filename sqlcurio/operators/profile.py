"""Corpus profiles: counts, means, shares, histograms, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")) * 100, F.lit(0.0))


def _mean(x: Column) -> Column:
    return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))


def profile(df: DataFrame, lengths: list[str] = (), flags: list[str] = (), ranges: list[str] = (), db: str | None = None, by: list[str] = ()) -> DataFrame:
    """One row (or one per ``by``): total, distinct dbs, mean and population deviation of lengths, percent of flags, min, max and mean of ranges. Empty input counts 0."""
    out = [F.count("*").alias("total_examples")]
    if db:
        out.append(F.countDistinct(db).alias("unique_dbs"))
    for c in lengths:
        out += [_mean(F.col(c)).alias(f"avg_{c}"), F.coalesce(F.stddev_pop(F.col(c).cast("double")), F.lit(0.0)).alias(f"std_{c}")]
    out += [_share(F.col(c)).alias(f"pct_{c}") for c in flags]
    for c in ranges:
        out += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), _mean(F.col(c)).alias(f"mean_{c}")]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))


def occurrence(df: DataFrame, array: str) -> DataFrame:
    """Rows by element of an array column."""
    return df.select(F.explode(array).alias("value")).groupBy("value").agg(F.count("*").alias("cnt"))


def multiplicity(df: DataFrame, column: str) -> DataFrame:
    """Percent of rows with none, any and several (two or more)."""
    return df.agg(_share(F.col(column) == 0).alias("pct_none"), _share(F.col(column) > 0).alias("pct_some"), _share(F.col(column) > 1).alias("pct_multi"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "value").limit(k)


def difficulty_distribution(df: DataFrame, dataset: str, difficulty: str, grid: bool = False) -> DataFrame:
    """Count and percent of each difficulty within its dataset; ``grid`` adds the pairs that don't occur."""
    counts = df.groupBy(F.col(dataset).alias("dataset"), F.col(difficulty).alias("difficulty")).agg(F.count("*").alias("cnt"))
    if grid:
        pairs = counts.select("dataset").distinct().join(counts.select("difficulty").distinct())
        counts = pairs.join(counts, ["dataset", "difficulty"], "left").select("dataset", "difficulty", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy("dataset"))
    return counts.withColumn("percentage", F.coalesce(F.bround(F.try_divide(100.0 * F.col("cnt"), total), 2), F.lit(0.0)))


def combine(profiles: list[DataFrame]) -> DataFrame:
    """Sums of difficulty counts over several (difficulty, cnt) profiles."""
    whole = profiles[0]
    for p in profiles[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("difficulty").agg(F.sum("cnt").alias("cnt"))


def group_sizes(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows by joined key, e.g. dataset, kind of database and database."""
    return df.groupBy(F.concat_ws("_", *[F.coalesce(k.cast("string"), F.lit("unknown")) for k in keys]).alias("schema_key")).agg(F.count("*").alias("cnt"))


def describe(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.agg(F.count("*").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *[F.percentile(x, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max(x).alias("max"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; with the newest row first, an upsert."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(own)).where("_rank = 1").drop("_rank")


def log_analysis(logs: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """Conversation logs by model and by dataset, and the schemas met most often."""
    return {
        "by_model": logs.groupBy("model").agg(
            F.count("*").alias("n"), _mean(F.col("response_length")).alias("mean_response_length"), _mean(F.col("success_rate")).alias("mean_success_rate"),
            _mean(F.col("accuracy")).alias("mean_accuracy"), F.sum("questions").alias("questions"),
        ),
        "by_dataset": logs.groupBy("dataset").agg(F.count("*").alias("n"), _mean(F.col("tables")).alias("mean_tables")),
        "top_schemas": top_values(logs, "schema_key", top),
    }


def compare_with_baseline(optimized: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """Both values of each metric by model and the relative gain; null where the baseline is 0."""
    out = []
    for m in metrics:
        out += [F.col(f"o.{m}").alias(f"{m}_optimized"), F.col(f"b.{m}").alias(f"{m}_baseline"), F.try_divide(F.col(f"o.{m}") - F.col(f"b.{m}"), F.col(f"b.{m}")).alias(f"{m}_gain")]
    return optimized.alias("o").join(baseline.alias("b"), F.col("o.model") == F.col("b.model")).select(F.col("o.model").alias("model"), *out)
