"""Chart-ready frames and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcurio.operators import profile, sampling


def charts(instances: DataFrame) -> dict[str, DataFrame]:
    """The frames behind the corpus charts, of instances with both analyses."""
    q, s = "question_analysis", "sql_analysis"
    lengths = instances.select(F.col(f"{q}.char_length").alias("question"), F.col(f"{s}.char_length").alias("statement"))
    flags = [f"has_{x}" for x in ("entities", "numbers", "negation", "comparatives", "superlatives")]
    kinds = instances.select(*[F.col(f"{q}.{f}").cast("int").alias(f) for f in flags]).unpivot([], flags, "flag", "value")
    return {
        "difficulty": profile.histogram(instances, "difficulty"),
        "lengths": lengths.unpivot([], ["question", "statement"], "text", "length").groupBy("text", F.floor(F.col("length") / 20).alias("bin")).agg(F.count("*").alias("cnt")),
        "joins": profile.histogram(instances, f"{s}.join_count"),
        "tables": profile.histogram(instances, f"{s}.tables_count"),
        "linguistic": kinds.groupBy("flag").agg((F.avg("value") * 100).alias("percent")),
        "aggregates": profile.occurrence(instances.select(F.col(f"{s}.aggregation_functions").alias("a")), "a"),
        "clauses": profile.occurrence(instances.select(F.col(f"{s}.clause_types").alias("c")), "c"),
    }


def score_trend(hits: DataFrame) -> DataFrame:
    """Score by rank over all queries."""
    return hits.groupBy("rank").agg(F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))


def melt_models(wide: DataFrame, key: str, models: list[str]) -> DataFrame:
    return wide.unpivot([key], models, "model", "value")


def subset_report(instances: DataFrame, subset: DataFrame, columns: list[str]) -> str:
    """Sizes, the share of every value on both sides and the mean deviation, as text.

    Only distinct values of ``columns`` reach the driver, the ten most frequent of each.
    """
    sizes = [d.count() for d in (instances, subset)]
    lines = [f"original {sizes[0]}, selected {sizes[1]}"]
    for c in columns:
        table = sampling.sample_report(instances, subset, c)
        mean = table.agg(F.avg("deviation")).first()[0] or 0.0
        lines.append(f"{c}: mean deviation {mean:.2f} points")
        lines += [f"  {r[c]}: {r['original']} ({r['original_pct']:.2f} %) -> {r['selected']} ({r['selected_pct']:.2f} %)" for r in table.orderBy(F.desc("original"), c).limit(10).collect()]
    return "\n".join(lines)
