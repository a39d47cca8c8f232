"""Writers: instances, feature tables with a manifest, schema CSVs, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcurio.operators.profile import first_per_key


def safe_name(name):
    return F.regexp_replace(name, r"[^\w\-]", "_")


def write_instances(df: DataFrame, path: str, per_file: int = 10_000, compression: str = "none") -> None:
    """JSON lines, partitioned by dataset where there is one; the folder is replaced."""
    out = df.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", compression)
    (out.partitionBy("dataset") if "dataset" in df.columns else out).json(path)


def write_features(frames: dict[str, DataFrame], path: str, form: str = "parquet", compression: str = "gzip", per_file: int = 100_000) -> DataFrame:
    """Each frame below ``path/<name>``, and the manifest as a frame of what was written."""
    rows = []
    for name, df in frames.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", compression).option("header", True).format(form).save(f"{path}/{name}")
        rows.append((name, f"{path}/{name}", form, compression, next(iter(frames.values())).sparkSession.read.format(form).option("header", True).load(f"{path}/{name}").count()))
    spark = next(iter(frames.values())).sparkSession
    manifest = spark.createDataFrame(rows, "name string, path string, format string, compression string, total_instances long").withColumn("date", F.current_timestamp())
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_schema_csv(df: DataFrame, path: str) -> None:
    """(db, table_name, description, DDL) as quoted CSV, a folder per db."""
    df.select("db", "table_name", "description", "DDL").write.mode("overwrite").partitionBy("db").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """Rows of ``new`` over those of ``old`` with the same keys, written to a new folder."""
    both = new.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    first_per_key(both, keys, [F.col("_age")]).drop("_age").write.mode("overwrite").parquet(path)


def metadata(instances: DataFrame, dataset: str) -> DataFrame:
    """One row: totals and instances by database."""
    by = instances.groupBy("db_id").agg(F.count("*").alias("n"))
    return by.agg(F.lit(dataset).alias("dataset_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_instances"), F.count("*").alias("total_unique_databases"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("db_id", F.lit("unknown")).alias("db_id"), "n")))).alias("database_instance_counts"))


def append_log(entries: DataFrame, path: str) -> None:
    """Conversation log entries (JSON lines), with their time and derived lengths."""
    entries.withColumn("logged_at", F.current_timestamp()).withColumn("response_length", F.length("response")).write.mode("append").json(path)
