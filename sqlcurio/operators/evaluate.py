"""Evaluation of predicted statements: result sets, the match cascade, rates by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcurio.functions.sqltext import exact_match
from sqlcurio.operators.execute import OTHER_COLUMNS, OTHER_ROWS, readable

# Explanations and reasons that results carry.
EXACT = "Exact match found"
EXECUTED = "Execution correct but not exact match"
FAILED = "Execution failed: "


def _positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def differing_rows(gold: DataFrame, predicted: DataFrame, bag: bool = False) -> DataFrame:
    """Rows of one side that the other lacks, columns by position, null equal to null.

    Sets by default: duplicates and order don't count. With ``bag`` multiplicities do. One aggregate
    over the union of both sides, so nothing is joined and equal rows shrink before the shuffle.
    """
    names = [f"c{k}" for k in range(len(gold.columns))]
    sides = _positional(gold).withColumn("_g", F.lit(1)).withColumn("_p", F.lit(0)).unionAll(_positional(predicted).withColumn("_g", F.lit(0)).withColumn("_p", F.lit(1)))
    counts = sides.groupBy(*names).agg(F.sum("_g").alias("_g"), F.sum("_p").alias("_p"))
    return counts.where(F.col("_g") != F.col("_p") if bag else (F.col("_g") == 0) | (F.col("_p") == 0))


def results_equal(gold: DataFrame, predicted: DataFrame, bag: bool = False) -> DataFrame:
    """One row: equal, and the reason if not."""
    if len(gold.columns) != len(predicted.columns):
        return gold.sparkSession.createDataFrame([(False, OTHER_COLUMNS)], "equal boolean, reason string")
    n = differing_rows(gold, predicted, bag).limit(1).agg(F.count("*").alias("n"))
    return n.select((F.col("n") == 0).alias("equal"), F.when(F.col("n") > 0, OTHER_ROWS).alias("reason"))


def check_execution(spark: SparkSession, gold: str, predicted: str, bag: bool = False) -> tuple[bool, str]:
    """Run both statements over the session's views and compare their results."""
    frames = []
    for name, sql in (("Ground truth execution error", gold), ("Execution error", predicted)):
        if not readable(sql):
            return False, f"{name}: only SELECT and WITH are run"
        try:
            frames.append(spark.sql(sql.strip().rstrip(";")))
        except Exception as e:  # any failure of foreign SQL is a verdict
            return False, f"{name}: {str(e).splitlines()[0]}"
    try:
        row = results_equal(*frames, bag=bag).first()
    except Exception as e:
        return False, f"Execution error: {str(e).splitlines()[0]}"
    return row["equal"], row["reason"] or ""


def cascade(exact: Column, executed: Column, error: Column, judged: Column) -> Column:
    """Semantic verdict: exact match, else equal results, else false on an error, else the judge's."""
    failed = F.coalesce(error, F.lit("")) != ""
    return F.struct(
        F.when(F.coalesce(exact, F.lit(False)), True).when(F.coalesce(executed, F.lit(False)), True).when(failed, False).otherwise(F.coalesce(judged, F.lit(False))).alias("semantic_equivalent"),
        F.when(F.coalesce(exact, F.lit(False)), EXACT).when(F.coalesce(executed, F.lit(False)), EXECUTED).when(failed, F.concat(F.lit(FAILED), error))
        .when(judged.isNull(), "Could not determine semantic equivalence").when(judged, "Judged equivalent").otherwise("Judged different").alias("semantic_explanation"),
    )


def evaluate(df: DataFrame, gold: str = "sql", predicted: str = "generated_sql", executed: str = "execution_correct", error: str = "execution_error", judged: str = "judged") -> DataFrame:
    exact = exact_match(F.col(gold), F.col(predicted))
    return df.withColumn("exact_match", exact).withColumn("_c", cascade(F.col("exact_match"), F.col(executed), F.col(error), F.col(judged))).select(*df.columns, "exact_match", "_c.*")


def metrics(df: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Rates by model; accuracies are shares of the predictions, 0 where there are none."""
    has = F.coalesce(F.col("has_prediction"), F.lit(False))
    n, p = F.count("*"), F.count_if(has)
    rate = lambda c: F.coalesce(F.try_divide(F.count_if(has & F.coalesce(F.col(c), F.lit(False))).cast("double"), p), F.lit(0.0))
    return df.groupBy(*by).agg(
        n.alias("num_evaluated"), p.alias("num_with_prediction"), F.coalesce(F.try_divide(p.cast("double"), n), F.lit(0.0)).alias("prediction_rate"),
        rate("execution_correct").alias("execution_accuracy"), rate("exact_match").alias("exact_match_accuracy"), rate("semantic_equivalent").alias("semantic_equivalent_accuracy"),
    )


def missing_predictions(instances: DataFrame, predictions: DataFrame, on: list[str]) -> DataFrame:
    done = predictions.where(F.coalesce(F.col("has_prediction"), F.lit(False))).select(*on).distinct()
    return instances.join(done, on, "left_anti")
