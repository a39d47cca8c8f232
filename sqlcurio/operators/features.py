"""Feature tables of questions, statements and schemas, and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcurio.functions.nl import ENTITY_FLAGS
from sqlcurio.functions.sqltext import AGGREGATES, CLAUSES

KEYS = ["dataset", "id", "db_id"]


def one_hot(array: Column, values: list[str], prefix: str) -> list[Column]:
    return [F.coalesce(F.array_contains(array, v), F.lit(False)).cast("int").alias(f"{prefix}_{v.lower().replace(' ', '_')}") for v in values]


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name.split(".")[-1])


def _question_columns(df: DataFrame) -> list[Column]:
    inner = df.schema["question_analysis"].dataType.fieldNames()
    q = "question_analysis"
    lists = ["entities", "numbers", "negation_words", "comparatives", "superlatives"]
    flags = ["has_entities", "has_numbers", "has_negation", "has_comparatives", "has_superlatives"]
    out = [_count(f"{q}.char_length"), _count(f"{q}.word_length")]
    out += [F.greatest(F.size(f"{q}.{c}"), F.lit(0)).alias(f"{c}_count") for c in lists]
    out += [F.coalesce(F.col(f"{q}.{c}"), F.lit(False)).cast("int").alias(c) for c in flags]
    out += one_hot(F.col(f"{q}.entity_types"), ENTITY_FLAGS, "entity")
    out += [_count(f"{q}.{c}") for c in inner if "overlap" in c or "similarity" in c]
    evidence = F.coalesce("evidence", F.lit(""))
    return [F.col("difficulty"), *out, (evidence != "").cast("int").alias("has_evidence"), F.length(evidence).alias("evidence_length")]


def _sql_columns() -> list[Column]:
    s = "sql_analysis"
    counts = ["char_length", "tables_count", "join_count", "where_conditions", "subquery_count", "clauses_count", "aggregation_function_count", "select_columns"]
    out = [F.coalesce(F.col(f"{s}.{c}"), F.lit(0)).alias(f"sql_{c}" if c == "char_length" else c) for c in counts]
    return [*out, *one_hot(F.col(f"{s}.clause_types"), CLAUSES, "has"), *one_hot(F.col(f"{s}.aggregation_functions"), AGGREGATES, "uses")]


def question_features(df: DataFrame) -> DataFrame:
    """Of instances with ``question_analysis``: lengths, counts, flags, one column per entity type, overlaps where known."""
    return df.select(*KEYS, *_question_columns(df))


def sql_features(df: DataFrame) -> DataFrame:
    """Of instances with ``sql_analysis``: counts, and one column per clause and aggregate."""
    return df.select(*KEYS, *_sql_columns())


def schema_features(schemas: DataFrame) -> DataFrame:
    """One row per (dataset, db_id) of a schema analysis."""
    counts = ["tables", "columns", "primary_keys", "foreign_keys"]
    return schemas.groupBy("dataset", "db_id").agg(*[F.max(F.coalesce(F.col(f"{c}_count"), F.lit(0))).alias(f"schema_{c}") for c in counts])


def combine_features(questions: DataFrame, statements: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Left joins of tables that were kept apart, on the keys, null matching null; a schema table joins many to one."""
    return _left(_left(questions, statements, KEYS), schemas, ["dataset", "db_id"])


def instance_features(df: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """What ``combine_features`` gives for instances that hold both analyses: one projection, no join of instances.

    Each row of ``df`` gives one, also where keys repeat.
    """
    return _left(df.select(*KEYS, *_question_columns(df), *_sql_columns()), schemas, ["dataset", "db_id"])


def _left(a: DataFrame, b: DataFrame | None, keys: list[str]) -> DataFrame:
    if b is None:
        return a
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.alias("a").join(b.alias("b"), on, "left").select("a.*", *[f"b.{c}" for c in b.columns if c not in keys])


def dataset_features(df: DataFrame, name: str) -> DataFrame:
    own = df.where(F.lower("dataset") == name.lower())
    evidence = F.coalesce("evidence", F.lit(""))
    if name.lower() == "bird":
        return own.select(*KEYS, (evidence != "").cast("int").alias("has_evidence"), F.length(evidence).alias("evidence_length"))
    return own.select(*KEYS, *[F.col("difficulty").alias("orig_difficulty")] * (name.lower() == "spider"))


def datasets(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("error").isNull()) if "error" in df.columns else df
    return rows.select(F.lower("dataset").alias("dataset")).distinct()
