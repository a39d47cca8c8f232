"""Readers of the benchmark layouts; every path goes through Spark's file systems."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlcurio.operators.sampling import everything
from sqlcurio.operators.standardize import standardize
from sqlcurio.sources.ddl import MISSING_SCHEMA

SPLITS = {"train": ["train_spider.json"], "dev": ["dev.json"]}
ENGINES = ["snowflake", "sqlite"]
CATALOG = "db string, table_name string, position int, name string, type string, is_pk boolean, ddl string, references_table string, references_column string"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def json_array(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """Records of JSON arrays (or single objects) in file order, with their position over all files.

    One file is one task, as an array can't be split. The position is a running number in the order
    of ``paths``: the rows of each task are counted, and a record's place in its task is added to the
    rows of the tasks before, so records are neither shuffled nor numbered together. ``limit`` keeps
    the first ones.
    """
    parts = []
    for n, p in enumerate(paths):
        d = spark.read.option("multiLine", True).json(p)
        parts.append(d.withColumn("_file", F.lit(n)).withColumn("_row", F.monotonically_increasing_id()))
    whole = parts[0]
    for d in parts[1:]:
        whole = whole.unionByName(d, allowMissingColumns=True)
    whole = whole.withColumn("_task", F.shiftright("_row", 33))  # the upper bits of the id number the task
    before = everything().orderBy("_file", "_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = whole.groupBy("_file", "_task").agg(F.count("*").alias("_n"))
    tasks = tasks.select(F.col("_file").alias("_f"), F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    whole = whole.join(tasks, (F.col("_file") == F.col("_f")) & (F.col("_task") == F.col("_t")))
    whole = whole.withColumn("pos", F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_file", "_row", "_task", "_f", "_t", "_before")
    return whole if limit is None else whole.where(F.col("pos") < limit)


def spider(spark: SparkSession, base: str, split: str = "train", include_others: bool = True, limit: int | None = None) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    names = SPLITS[split] + ["train_others.json"] * (split == "train" and include_others)
    return json_array(spark, [f"{base}/{n}" for n in names], limit)


def spider_catalog(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """tables.json as tables, columns and foreign keys; a column without a pair has table -1."""
    raw = spark.read.option("multiLine", True).schema(
        "db_id string, table_names array<string>, table_names_original array<string>, column_names array<array<string>>, column_names_original array<array<string>>, column_types array<string>, foreign_keys array<array<int>>, primary_keys array<int>"
    ).json(f"{base}/tables.json")
    tables = raw.select("db_id", F.posexplode(F.arrays_zip("table_names", "table_names_original")).alias("table_id", "t")).select("db_id", "table_id", F.col("t.table_names").alias("name"), F.col("t.table_names_original").alias("original_name"))
    columns = raw.select("db_id", "primary_keys", F.posexplode(F.arrays_zip("column_names", "column_names_original", "column_types")).alias("column_id", "c"))
    at = lambda a, k: F.try_element_at(a, F.lit(k))
    columns = columns.select(
        "db_id", "column_id", F.coalesce(at(F.col("c.column_names"), 1).cast("int"), F.lit(-1)).alias("table_id"), at(F.col("c.column_names"), 2).alias("name"),
        at(F.col("c.column_names_original"), 2).alias("original_name"), F.coalesce("c.column_types", F.lit("text")).alias("type"), F.coalesce(F.array_contains("primary_keys", F.col("column_id")), F.lit(False)).alias("is_pk"),
    )
    keys = raw.select("db_id", F.explode("foreign_keys").alias("k")).select("db_id", at(F.col("k"), 1).alias("from_column_id"), at(F.col("k"), 2).alias("to_column_id"))
    return {"tables": tables, "columns": columns, "foreign_keys": keys}


def bird(spark: SparkSession, base: str, split: str = "dev", limit: int | None = None) -> DataFrame:
    return json_array(spark, [f"{base}/{split}.json"], limit)


def column_descriptions(spark: SparkSession, glob: str, encoding: str = "UTF-8") -> DataFrame:
    """database_description CSVs: (db, table_name, column_name, column_description, value_description)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("mode", "DROPMALFORMED").option("encoding", encoding).csv(glob)
    parts = F.split(F.col("_metadata.file_path"), "/")
    keep = [F.trim(F.col(c)).alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("column_name", "column_description", "value_description")]
    return raw.select(F.element_at(parts, -3).alias("db"), stem(F.col("_metadata.file_path")).alias("table_name"), *keep)


def describe_columns(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Catalog columns with their descriptions, joined without regard to case; the first of doubles counts."""
    low = descriptions.groupBy(F.lower("db").alias("_d"), F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c")).agg(F.min(F.struct("column_description", "value_description")).alias("x"))
    on = (F.lower(columns["db"]) == F.col("_d")) & (F.lower(columns["table_name"]) == F.col("_t")) & (F.lower(columns["name"]) == F.col("_c"))
    return columns.join(low, on, "left").select(*[columns[c] for c in columns.columns], F.col("x.column_description").alias("description"), F.col("x.value_description").alias("value_description"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file, or of several in the order of their names, read in splits like any other.

    Lines are counted by split; a line's number is its place in its split behind the lines of the splits
    before, of which there is a row each.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    # within a task ids run on, and the lines of a split are next to one another
    lines = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = everything().orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(F.broadcast(splits), ["_file", "_start"]).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("pos"), "line")


def spider2_lite(spark: SparkSession, jsonl: str, gold: str, knowledge: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines with their gold statement (required) and knowledge text (optional); ids are line numbers."""
    raw = numbered_lines(spark, jsonl).where("trim(line) <> ''")
    rows = raw.select(F.col("pos").cast("long"), F.from_json("line", "instance_id string, db string, db_id string, question string, instruction string, query string, external_knowledge string").alias("r")).select("pos", "r.*")
    rows = rows if limit is None else rows.where(F.col("pos") < limit)
    texts = lambda path: spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_file"), F.trim("value").alias("_text"))
    sql = texts(gold).select(F.regexp_replace("_file", r"\.sql$", "").alias("instance_id"), F.col("_text").alias("sql"))
    out = rows.withColumn("question", F.coalesce("question", "instruction", "query")).drop("instruction", "query").join(sql, "instance_id")
    if knowledge:
        notes = texts(knowledge).select(F.col("_file").alias("external_knowledge"), F.col("_text").alias("evidence"))
        out = out.join(notes, "external_knowledge", "left")
    return out.where("question is not null and (db is not null or db_id is not null)")


def spider2_schemas(spark: SparkSession, base: str) -> DataFrame:
    """Table files ``engine/db[/schema]/table.json``: one row per column; short lists are padded."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema("table_fullname string, nested_column_names array<string>, nested_column_types array<string>, description array<string>").json(base)
    tail = F.split(F.substring_index(F.col("_metadata.file_path"), base.rstrip("/").split("/")[-1] + "/", -1), "/")
    raw = raw.select(tail.alias("_p"), "*")
    name = F.when(F.size("_p").isin(3, 4), F.array_join(F.slice("_p", 1, F.size("_p") - 1), "_$_"))
    rows = raw.select(F.col("_p")[0].alias("engine"), F.col("_p")[1].alias("db"), name.alias("schema_name"), "table_fullname", F.posexplode(F.arrays_zip("nested_column_names", "nested_column_types", "description")).alias("position", "c"))
    return rows.where(F.col("engine").isin(ENGINES)).select("engine", "db", "schema_name", "table_fullname", "position", F.col("c.nested_column_names").alias("name"), F.coalesce("c.nested_column_types", F.lit("TEXT")).alias("type"), F.col("c.description").alias("description"))


def listing(spark: SparkSession, glob: str, engine: str | None = None) -> DataFrame:
    """(db, paths[, engine]) of the files below ``<db>/``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path", F.element_at(F.split("path", "/"), -2).alias("db"))
    out = files.groupBy("db").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return out.withColumn("engine", F.lit(engine)) if engine else out


def sqlite_catalog(spark: SparkSession, glob: str) -> DataFrame:
    """Columns, keys and DDL of every table of the SQLite files, one file to a task; a column has a row per foreign key.

    Files come as bytes through Spark, so stores that only Spark reads work; a task keeps its file
    in its own temporary folder while it reads the catalog.
    """
    files = spark.read.format("binaryFile").load(glob).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("db"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for db, content in zip(batch["db"], batch["content"], strict=True):
                rows = list(catalog_rows(db, bytes(content)))
                yield pd.DataFrame(rows, columns=["db", "table_name", "position", "name", "type", "is_pk", "ddl", "references_table", "references_column"])

    return files.mapInPandas(read, CATALOG)


def catalog_rows(db: str, content: bytes) -> Iterator[tuple]:
    handle, path = tempfile.mkstemp(suffix=".sqlite")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        con = sqlite3.connect(path)
        quote = lambda t: '"' + t.replace('"', '""') + '"'
        for table, ddl in con.execute("select name, sql from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\' and sql is not null order by name"):
            indexes = [x for (x,) in con.execute("select sql from sqlite_master where type = 'index' and tbl_name = ? and sql is not null order by name", (table,))]
            text = ";\n".join([ddl, *indexes]) + ";"
            keys: dict[str, list[tuple]] = {}
            for r in con.execute(f"pragma foreign_key_list({quote(table)})"):
                keys.setdefault(r[3], []).append((r[2], r[4]))
            for cid, name, kind, _, _, pk in con.execute(f"pragma table_info({quote(table)})"):
                for to in sorted(keys.get(name, [(None, None)]), key=str):
                    yield db, table, cid, name, (kind or "TEXT").upper(), pk > 0, text, to[0], to[1]
        con.close()
    finally:
        os.unlink(path)


def schema_csv(spark: SparkSession, glob: str) -> DataFrame:
    """(schema_name, table_name, description, DDL) of quoted, multi-line schema CSVs.

    A record whose quoting is broken is read again by its shape: the name up to the first comma, the
    statement from CREATE on, what lies between as description. Where that fails too, the DDL is the sentinel.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").schema("table_name string, description string, DDL string, broken string").csv(glob)
    )
    shape = r'(?is)^\s*"?([^",]*)"?\s*,(.*?),?[\s"]*(CREATE\s.*?)[\s"]*$'
    again = lambda k: F.nullif(F.btrim(F.regexp_extract("broken", shape, k), F.lit('" ,')), F.lit(""))
    read = lambda c, k: F.when(F.col("broken").isNull(), F.col(c)).otherwise(F.coalesce(again(k), F.col(c)) if k < 3 else again(k))
    return raw.select(
        stem(F.col("_metadata.file_path")).alias("schema_name"), read("table_name", 1).alias("table_name"),
        F.coalesce(read("description", 2), F.lit("")).alias("description"), F.coalesce(read("DDL", 3), F.lit(MISSING_SCHEMA)).alias("DDL"),
    )


def enriched(spark: SparkSession, path: str) -> DataFrame:
    """instance_*.json files below ``path`` with their file path."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "instance_*.json").json(path).withColumn("file_path", F.col("_metadata.file_path"))


def processed(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """Records of processed files, at most ``limit`` of each file."""
    parts = [json_array(spark, [p], limit) for p in paths]
    whole = parts[0]
    for d in parts[1:]:
        whole = whole.unionByName(d, allowMissingColumns=True)
    return whole


def subset_input(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Instances, and (db, table_count) of the schemas, of a file ``{instances: [...], schemas: {db: {table_count}}}``, gzip or not."""
    instances = spark.read.option("multiLine", True).json(path).select(F.explode("instances").alias("i")).select("i.*")
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "schemas map<string, struct<table_count: long>>").alias("j"))
    return instances, raw.select(F.explode("j.schemas").alias("db", "s")).select("db", "s.table_count")


REGISTRY: dict[str, Callable[..., DataFrame]] = {"spider": spider, "bird": bird, "spider2": spider2_lite}


def get_dataset(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    """The reader of a benchmark by name, standardised to instance rows."""
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown dataset {name!r}")
    raw = REGISTRY[name.lower()](spark, *args, **options)
    return standardize(raw, name.lower(), F.col("pos"))


def with_schema(instances: DataFrame, schemas: DataFrame) -> DataFrame:
    """Instances with ``schema_tables`` of their database, by name without regard to case; others drop out."""
    packed = schemas.groupBy(F.lower("schema_name").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("table_name", "description", "DDL", "schema_name"))).alias("schema_tables"))
    return instances.join(packed, F.lower("db_id") == F.col("_s")).drop("_s")


def example_at(rows: DataFrame, position: int) -> DataFrame:
    """The record at a position; no row where the position is out of range."""
    return rows.where(F.col("pos") == position)


def schema_of(schemas: DataFrame, name: str, column: str = "schema_name") -> DataFrame:
    """The rows of one schema, its name taken without regard to case."""
    return schemas.where(F.lower(column) == name.lower())


def table_samples(spark: SparkSession, tables: list[str], n: int = 5) -> dict[str, DataFrame]:
    """The first rows of each table of a database; a table that can't be read gives an empty frame."""
    out = {}
    for name in tables:
        try:
            out[name] = spark.table(f"`{name}`").limit(n)
        except Exception:  # the catalog may name tables that are gone
            out[name] = spark.createDataFrame([], "missing string")
    return out


def processed_dir(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A processed folder: ``instances`` and ``schemas`` with a db name (else the file's), and ``metadata``."""
    read = lambda what: spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(f"{path}/{what}")
    schemas = read("schemas/*.json").withColumn("_stem", stem(F.col("_metadata.file_path")))
    name = F.coalesce("db_name", "_stem") if "db_name" in schemas.columns else F.col("_stem")
    return {"instances": read("instances/*.json"), "schemas": schemas.withColumn("db_name", name).drop("_stem"), "metadata": read("metadata.json")}


def sqlite_rows(spark: SparkSession, glob: str, per_table: int | None = None) -> DataFrame:
    """(db, table_name, row, values) of every table of the SQLite files, or its first rows; values as text by column."""
    files = spark.read.format("binaryFile").load(glob).select(stem(F.col("path")).alias("db"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for db, content in zip(batch["db"], batch["content"], strict=True):
                handle, path = tempfile.mkstemp(suffix=".sqlite")
                try:
                    with os.fdopen(handle, "wb") as f:
                        f.write(bytes(content))
                    con = sqlite3.connect(path)
                    con.text_factory = lambda b: b.decode("utf-8", "replace")
                    for table in [t for (t,) in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\'")]:
                        cursor = con.execute('select * from "{}"'.format(table.replace('"', '""')) + (f" limit {int(per_table)}" if per_table is not None else ""))
                        names, at = [c[0] for c in cursor.description], 0
                        while rows := cursor.fetchmany(1000):
                            values = [{n: None if v is None else str(v) for n, v in zip(names, r, strict=True)} for r in rows]
                            yield pd.DataFrame({"db": db, "table_name": table, "row": range(at, at + len(rows)), "values": values})
                            at += len(rows)
                    con.close()
                finally:
                    os.unlink(path)

    return files.mapInPandas(read, "db string, table_name string, row long, values map<string,string>")


def register_sqlite(spark: SparkSession, glob: str, db: str) -> list[str]:
    """Temporary views of one database's tables, typed by its catalog, for statements to run over."""
    catalog = sqlite_catalog(spark, glob).where(F.col("db") == db).select("table_name", "position", "name", "type").distinct().orderBy("table_name", "position").collect()
    rows, tables = sqlite_rows(spark, glob).where(F.col("db") == db), {}
    for r in catalog:  # a catalog, not data: a row per column of one database
        tables.setdefault(r["table_name"], []).append((r["name"], r["type"]))
    for table, columns in tables.items():
        kind = lambda t: "bigint" if "INT" in t else "double" if any(k in t for k in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"
        cols = [F.try_element_at("values", F.lit(n)).try_cast(kind(t)).alias(n) for n, t in columns]
        rows.where(F.col("table_name") == table).select(cols).createOrReplaceTempView("`" + table.replace("`", "``") + "`")
    return sorted(tables)
