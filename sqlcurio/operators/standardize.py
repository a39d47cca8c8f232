"""The dialects of question-to-SQL records brought to one typed instance row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTANCE = """id long, original_instance_id string, question_uid string, dataset string, db_id string,
  database struct<name:string, path:array<string>, type:string, csv_files:array<string>>,
  schema_ref struct<name:string, path:array<string>, type:string>,
  question string, sql string, evidence string, difficulty string"""

#: Names under which the dialects keep a field, in the order of preference.
FIELDS = {
    "question": ["question", "instruction"],
    "sql": ["sql", "SQL", "query"],
    "db_id": ["db_id", "db"],
    "evidence": ["evidence", "external_knowledge"],
    "original_instance_id": ["id", "question_index", "question_id", "instance_id"],
    "difficulty": ["difficulty"],
}


def pick(df: DataFrame, field: str, default: str | None = "") -> Column:
    """The first of a field's names that the frame has and that is not null, by exact name."""
    there = [F.col(f"`{n}`").cast("string") for n in FIELDS[field] if n in df.columns]
    return F.coalesce(*there, F.lit(default)) if there else F.lit(default).cast("string")


def question_uid(dataset: Column, original: Column, question: Column, db: Column, sql: Column) -> Column:
    """``{dataset}_{original}_g_`` and 8 characters of the URL-safe base64 of the record's SHA-256."""
    digest = F.base64(F.unhex(F.sha2(F.concat_ws("_", dataset, question, db, sql), 256)))
    return F.concat(dataset, F.lit("_"), original, F.lit("_g_"), F.substring(F.translate(digest, "+/", "-_"), 1, 8))


def standardize(df: DataFrame, dataset: str, position: Column | None = None, difficulty: Column | None = None) -> DataFrame:
    """Instance rows of any dialect. The id is the record's own number where it has one, else ``position``.

    Structs ``database`` and ``schema_ref`` are taken over where the frame has them; a path that is
    one string becomes an array of it.
    """
    original, question, db, sql = pick(df, "original_instance_id", "NO"), pick(df, "question"), pick(df, "db_id"), pick(df, "sql")
    own_id = F.expr("try_cast(question_id as bigint)") if "question_id" in df.columns else F.expr("try_cast(id as bigint)") if "id" in df.columns else F.lit(None).cast("long")
    kinds = dict(df.dtypes)

    def paths(name: str) -> Column:
        kind = kinds.get(name, "")
        if not kind.startswith("struct"):
            return F.array().cast("array<string>")
        inner = {f.name: f.dataType.simpleString() for f in df.schema[name].dataType}
        if "path" not in inner:
            return F.array().cast("array<string>")
        return F.col(f"{name}.path") if inner["path"].startswith("array") else F.array(F.col(f"{name}.path"))

    def part(name: str, field: str) -> Column:
        has = name in kinds and kinds[name].startswith("struct") and field in df.schema[name].dataType.fieldNames()
        return F.col(f"{name}.{field}") if has else F.lit(None).cast("array<string>" if field == "csv_files" else "string")

    schema = next((n for n in ("schema_ref", "schemas") if n in kinds), "schemas")
    level = difficulty if difficulty is not None else pick(df, "difficulty", "unknown")
    return df.select(
        F.coalesce(own_id, position if position is not None else F.lit(None).cast("long")).alias("id"),
        original.alias("original_instance_id"),
        question_uid(F.lit(dataset), original, question, db, sql).alias("question_uid"),
        F.lit(dataset).alias("dataset"),
        F.coalesce(F.nullif(db, F.lit("")), part("database", "name")).alias("db_id"),
        F.struct(part("database", "name").alias("name"), paths("database").alias("path"), part("database", "type").alias("type"), part("database", "csv_files").alias("csv_files")).alias("database"),
        F.struct(part(schema, "name").alias("name"), paths(schema).alias("path"), part(schema, "type").alias("type")).alias("schema_ref"),
        question.alias("question"), sql.alias("sql"), pick(df, "evidence").alias("evidence"), level.alias("difficulty"),
    )


def model_name(name: Column) -> Column:
    """What stands behind the first slash of a model's name, else all of it."""
    return F.coalesce(F.try_element_at(F.split(name, "/"), F.lit(2)), name)


def group_predictions(predictions: DataFrame) -> DataFrame:
    """One row for each (dataset, id): its first record and all inference results."""
    return predictions.groupBy("dataset", "id").agg(F.min(F.struct("question", "sql")).alias("instance"), F.sort_array(F.collect_list("inference_results")).alias("inference_results"))


def pivot_predictions(predictions: DataFrame, models: list[str], value: str) -> DataFrame:
    return predictions.groupBy("dataset", "id").pivot("model", models).agg(F.first(value))


def choose_engine(paths: DataFrame, engines: list[str], db: str = "db") -> DataFrame:
    """For each db the first engine, in the caller's order, that has paths."""
    order = F.array_position(F.array(*map(F.lit, engines)), F.col("engine"))
    usable = paths.where(F.col("engine").isin(engines) & F.col("paths").isNotNull()).withColumn("_o", order)
    best = usable.groupBy(db).agg(F.min(F.struct("_o", "engine", "paths")).alias("b"))
    return best.select(db, "b.engine", "b.paths")


def rewrite_paths(paths: Column, folder: Column) -> Column:
    """Base names below another folder."""
    return F.transform(paths, lambda p: F.concat(folder, F.lit("/"), F.element_at(F.split(p, "/"), -1)))
