"""Exact-size, reproducible subsets: quotas on the table of strata, membership by hash order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def everything():
    """One window over all rows of a small table."""
    return Window.partitionBy(F.lit(0))


def same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of the key columns of two aliased frames; nulls match."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def strata(df: DataFrame, by: list[str]) -> DataFrame:
    """cnt rows of each stratum. All windows of this module but those on boundary rows run on such tables."""
    return df.groupBy(*by).agg(F.count("*").alias("cnt"))


def _order(by: list[str], first: Column) -> list[Column]:
    return [first, *[F.col(c).asc_nulls_first() for c in by]]


def proportional_quota(counts: DataFrame, by: list[str], target: int, least: int = 1) -> DataFrame:
    """Shares of ``target`` rounded half to even, at least ``least`` and at most the stratum.

    What is missing is poured into the largest strata first, what is too much drained from the
    smallest down to the minimum: both by prefix sums instead of a loop.
    """
    share = F.bround(F.try_divide(F.col("cnt") * F.lit(target), F.sum("cnt").over(everything())), 0)
    df = counts.withColumn("_a", F.least(F.greatest(F.lit(least), share), F.col("cnt")).cast("long"))
    df = df.withColumn("_need", F.lit(target) - F.sum("_a").over(everything())).withColumn("_room", F.col("cnt") - F.col("_a")).withColumn("_slack", F.greatest(F.col("_a") - least, F.lit(0)))
    before = lambda what, order: F.coalesce(F.sum(what).over(everything().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    clamp = lambda x, most: F.least(F.greatest(x, F.lit(0)), most)
    up = clamp(F.col("_need") - before("_room", _order(by, F.desc("cnt"))), F.col("_room"))
    down = clamp(-F.col("_need") - before("_slack", _order(by, F.asc("cnt"))), F.col("_slack"))
    quota = F.when(F.col("_need") > 0, F.col("_a") + up).when(F.col("_need") < 0, F.col("_a") - down).otherwise(F.col("_a"))
    return df.select(*by, "cnt", quota.cast("long").alias("quota"))


def uniform_quota(counts: DataFrame, by: list[str], target: int) -> DataFrame:
    """The same for all: target div strata, bound by the smallest stratum; a remainder goes to the largest."""
    strata_n = F.count("*").over(everything())
    even, smallest = F.floor(F.lit(target) / strata_n), F.min("cnt").over(everything())
    rank = F.row_number().over(everything().orderBy(*_order(by, F.desc("cnt"))))
    quota = F.when(even > smallest, smallest).otherwise(even + F.when((rank <= F.lit(target) % strata_n) & (even < F.col("cnt")), 1).otherwise(0))
    return counts.select(*by, "cnt", quota.cast("long").alias("quota"))


def two_level_quota(counts: DataFrame, level: str, db: str, target: int, seed: str = "42") -> DataFrame:
    """Shares of ``target`` by ``level`` (residual to the largest), then evenly over its ``db`` values.

    Where even shares exceed a level's smallest db, the target shrinks once to what is feasible. The
    remainder within a level goes one each to dbs in the order of a seeded hash.
    """
    levels = counts.groupBy(level).agg(F.sum("cnt").alias("_n"), F.count("*").alias("_dbs"), F.min("cnt").alias("_least"))
    levels = levels.withColumn("_ratio", F.col("_n") / F.sum("_n").over(everything()))
    first = F.row_number().over(everything().orderBy(F.desc("_n"), F.col(level).asc_nulls_first())) == 1

    def shared(df: DataFrame, goal: Column) -> DataFrame:
        df = df.withColumn("_goal", goal).withColumn("_t", F.bround(F.col("_ratio") * F.col("_goal"), 0))
        return df.withColumn("_t", (F.col("_t") + F.when(first, F.col("_goal") - F.sum("_t").over(everything())).otherwise(0)).cast("long"))

    levels = shared(levels, F.lit(float(target)))
    short = F.when(F.col("_t") / F.col("_dbs") > F.col("_least"), F.floor(F.col("_least") * F.col("_dbs") / F.col("_ratio")))
    levels = levels.withColumn("_feasible", F.least(F.lit(float(target)), F.min(short).over(everything()).cast("double")))
    levels = shared(levels, F.coalesce(F.col("_feasible"), F.lit(float(target))))
    lot = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"c.{level}").cast("string"), F.lit("")), F.coalesce(F.col(f"c.{db}").cast("string"), F.lit(""))))
    joined = counts.alias("c").join(levels.alias("l"), same("c", "l", [level])).select("c.*", "_t", "_dbs", lot.alias("_lot"))
    rank = F.row_number().over(Window.partitionBy(level).orderBy("_lot", F.col(db).asc_nulls_first()))
    quota = F.floor(F.col("_t") / F.col("_dbs")) + F.when(rank <= F.col("_t") % F.col("_dbs"), 1).otherwise(0)
    return joined.select(level, db, "cnt", F.least(quota, F.col("cnt")).cast("long").alias("quota"))


def largest_remainder_quota(counts: DataFrame, by: list[str], target: int | Column) -> DataFrame:
    """floor(target * share), and one more for the largest fractions until the target is met."""
    goal = F.lit(target) if isinstance(target, int) else target
    total = F.sum("cnt").over(everything())
    df = counts.withColumn("_floor", F.floor(goal * F.col("cnt") / total)).withColumn("_rest", (goal * F.col("cnt")) % total).withColumn("_goal", goal)
    rank = F.row_number().over(everything().orderBy(*_order(by, F.desc("_rest"))))
    open_ = F.least(F.col("_goal"), total) - F.sum("_floor").over(everything())
    return df.select(*by, "cnt", F.least(F.col("_floor") + F.when(rank <= open_, 1).otherwise(0), F.col("cnt")).cast("long").alias("quota"))


def lot(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def quota_sample(df: DataFrame, quotas: DataFrame, by: list[str], key: str, seed: str = "42") -> DataFrame:
    """The first ``quota`` rows of each stratum in the order of a seeded hash of ``key``.

    Rows are counted by stratum and leading hash digits first. Whole bins below the cut are taken as
    they are; only the one bin a stratum's cut falls in is ranked, so a stratum with most of the
    rows is never sorted in one task.
    """
    marked = df.withColumn("_lot", lot(seed, key)).withColumn("_bin", F.substring("_lot", 1, 3))
    own = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = marked.groupBy(*by, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    cuts = bins.alias("b").join(quotas.alias("q"), same("b", "q", by)).where("_before < quota").select("b.*", "quota")
    joined = marked.alias("d").join(cuts.alias("c"), same("d", "c", [*by, "_bin"])).select("d.*", "_before", "_n", "quota")
    whole = joined.where("_before + _n <= quota")
    rank = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_lot", key))
    partly = joined.where("_before + _n > quota").withColumn("_rank", rank).where("_rank <= quota - _before")
    return whole.select(df.columns).unionAll(partly.select(df.columns))


def split(df: DataFrame, key: str, test_share: float = 0.2, by: list[str] | None = None, seed: str = "42") -> DataFrame:
    """``is_test`` for each row: ceil(test_share * n) rows in all, by largest remainder within ``by``."""
    given = by or []
    named = df if given else df.withColumn("_all", F.lit(1))
    keys = given or ["_all"]
    goal = F.ceil(F.round(F.lit(test_share) * F.sum("cnt").over(everything()), 9))
    quotas = largest_remainder_quota(strata(named, keys), keys, goal)
    test = quota_sample(named, quotas, keys, key, seed).select(F.col(key).alias("_test_key")).distinct()
    joined = df.join(test, df[key].eqNullSafe(test["_test_key"]), "left")
    return joined.select(*[df[c] for c in df.columns], F.col("_test_key").isNotNull().alias("is_test"))


def sample_report(df: DataFrame, sample: DataFrame, by: str) -> DataFrame:
    """Share of each value of ``by`` before and after, in percent, and the absolute difference."""
    a = df.groupBy(by).agg(F.count("*").alias("original"))
    b = sample.groupBy(by).agg(F.count("*").alias("selected"))
    joined = a.alias("a").join(b.alias("b"), same("a", "b", [by]), "left").select(f"a.{by}", "original", F.coalesce("selected", F.lit(0)).alias("selected"))
    percent = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.sum(c).over(everything())), F.lit(0.0))
    out = joined.withColumn("original_pct", percent("original")).withColumn("selected_pct", percent("selected"))
    return out.withColumn("deviation", F.abs(F.col("original_pct") - F.col("selected_pct")))


def compare_distributions(df: DataFrame, sample: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """Relative frequency of each value of ``columns`` on both sides: (variable, value, original, subset)."""
    tag = lambda d, side: d.select(F.lit(side).alias("side"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = tag(df, "original").unionAll(tag(sample, "subset")).unpivot(["side"], columns, "variable", "value")
    n = long.groupBy("variable", "value").agg(*[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(s) for s in ("original", "subset")])
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(Window.partitionBy("variable"))), F.lit(0.0))
    out = n.withColumn("_o", share("original")).withColumn("_s", share("subset"))
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("variable").orderBy(F.desc("original"), F.col("value").asc_nulls_first()))
        out = out.withColumn("_rank", rank).where(F.col("_rank") <= top)
    return out.select("variable", "value", F.col("_o").alias("original"), F.col("_s").alias("subset"))


def referenced(schemas: DataFrame, subset: DataFrame, on: str) -> DataFrame:
    return schemas.join(subset.select(on).distinct(), on, "left_semi")
