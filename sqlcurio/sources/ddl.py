"""CREATE TABLE statements to catalog rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING_SCHEMA = "missing schema or crupted schema"  # fixed value: the sentinel of unreadable schema files
_NAME = r'(?:"[^"]*"|`[^`]*`|\[[^\]]*\]|[^\s(,.]+)'
_HEAD = re.compile(rf"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY|TRANSIENT|EXTERNAL)\s+)*TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME}(?:\.{_NAME})*)\s*\(", re.I)
_FOREIGN = re.compile(rf"FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+({_NAME}(?:\.{_NAME})*)\s*(?:\(([^)]*)\))?", re.I)
_INLINE = re.compile(rf"\bREFERENCES\s+({_NAME}(?:\.{_NAME})*)\s*(?:\(([^)]*)\))?", re.I)
_PRIMARY = re.compile(r"PRIMARY\s+KEY\s*\(([^)]*)\)", re.I)
_TABLE_RULE = re.compile(r"(?:CONSTRAINT\s+\S+\s+)?(?:PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|KEY|INDEX)\b", re.I)
_AFTER_TYPE = re.compile(r"\s(?:NOT|NULL|PRIMARY|UNIQUE|DEFAULT|REFERENCES|CHECK|COLLATE|CONSTRAINT|AUTOINCREMENT|COMMENT|GENERATED|ON)\b", re.I)

SCHEMA = """table_name string, columns array<struct<name:string,type:string,is_pk:boolean>>,
  primary_keys array<string>, foreign_keys array<struct<column:string,references_schema:string,references_table:string,references_column:string>>"""


def unquote(name: str) -> str:
    name = name.strip()
    return name[1:-1] if len(name) > 1 and name[0] + name[-1] in ('""', "``", "[]", "''") else name


def pieces(body: str) -> Iterator[str]:
    """Parts between commas outside brackets and quotes."""
    depth, quote, at = 0, "", 0
    for k, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and not depth:
            yield body[at:k].strip()
            at = k + 1
    if body[at:].strip():
        yield body[at:].strip()


def inside(text: str, start: int) -> str:
    """What stands between the bracket before ``start`` and its partner."""
    depth, quote = 1, ""
    for k in range(start, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return text[start:k]
    return text[start:]


def _names(listed: str | None) -> list[str]:
    return [unquote(x) for x in (listed or "").split(",") if x.strip()]


def parse_ddl(ddl: str | None) -> dict[str, Any] | None:
    """The catalog of one statement; None for anything that is no CREATE TABLE.

    Works for SQLite and Snowflake alike: names may be dotted and quoted, types may hold commas.
    Foreign keys without a target column point at none (the target's primary key).
    """
    head = _HEAD.match(ddl or "")
    if not head:
        return None
    table, columns, primary, foreign = [unquote(x) for x in re.findall(_NAME, head[1])][-1], [], [], []

    def refer(own: list[str], target: str, theirs: str | None) -> None:
        path, to = [unquote(x) for x in re.findall(_NAME, target)], _names(theirs)
        for k, column in enumerate(own):
            foreign.append({"column": column, "references_schema": path[-2] if len(path) > 1 else None, "references_table": path[-1], "references_column": to[k] if k < len(to) else None})

    for part in pieces(inside(ddl, head.end())):
        if _TABLE_RULE.match(part):
            if m := _FOREIGN.search(part):
                refer(_names(m[1]), m[2], m[3])
            elif m := _PRIMARY.search(part):
                primary += _names(m[1])
            continue
        m = re.match(rf"({_NAME})\s*(.*)", part, re.S)
        name, rest = unquote(m[1]), " " + m[2]
        end = _AFTER_TYPE.search(rest)
        columns.append({"name": name, "type": (rest[: end.start()] if end else rest).strip().upper() or "TEXT"})
        if re.search(r"\bPRIMARY\s+KEY\b", rest, re.I):
            primary.append(name)
        if m := _INLINE.search(rest):
            refer([name], m[1], m[2])
    keys = {p.lower() for p in primary}
    return {"table_name": table, "columns": [c | {"is_pk": c["name"].lower() in keys} for c in columns], "primary_keys": primary, "foreign_keys": foreign}


def parse_tables(schemas: DataFrame, ddl: str = "DDL") -> DataFrame:
    """``parsed`` for each row; null where the text is missing, the sentinel, or no CREATE TABLE."""

    @F.pandas_udf(f"struct<{SCHEMA.replace(chr(10), ' ')}>".replace(" string", ":string").replace(" array", ":array"))
    def parsed(texts: pd.Series) -> pd.DataFrame:
        empty = {"table_name": None, "columns": None, "primary_keys": None, "foreign_keys": None}
        return pd.DataFrame([parse_ddl(t) or empty for t in texts], columns=list(empty))

    rows = schemas.withColumn("parsed", parsed(F.col(ddl)))
    return rows.withColumn("parsed", F.when(F.col("parsed.table_name").isNotNull() & (F.col(ddl) != MISSING_SCHEMA), F.col("parsed")))


def schema_columns(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per column of the catalog."""
    return parsed.where("parsed is not null").select(*keys, F.col("parsed.table_name").alias("table_name"), F.posexplode("parsed.columns").alias("position", "c")).select(*keys, "table_name", "position", "c.name", "c.type", "c.is_pk")


def schema_foreign_keys(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.where("parsed is not null").select(*keys, F.col("parsed.table_name").alias("table_name"), F.explode("parsed.foreign_keys").alias("f")).select(*keys, "table_name", "f.*")


def analyze_schema(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of tables, columns and keys, mean columns per table, and the histogram of types of each schema."""
    rows = parsed.where("parsed is not null")
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("tables_count"), F.sum(F.size("parsed.columns")).alias("columns_count"),
        F.sum(F.size("parsed.primary_keys")).alias("primary_keys_count"), F.sum(F.size("parsed.foreign_keys")).alias("foreign_keys_count"),
    ).withColumn("columns_per_table", F.col("columns_count") / F.col("tables_count"))
    types = rows.select(*keys, F.explode("parsed.columns.type").alias("type")).groupBy(*keys, "type").agg(F.count("*").alias("n"))
    types = types.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("datatype_counts"))
    return counts.join(types, keys, "left")


def clean_ddl(ddl: str = "DDL", description: str = "description") -> dict:
    """Columns with doubled quotes and escaped line breaks undone, and null descriptions empty."""
    text = F.replace(F.replace(F.btrim(F.col(ddl), F.lit('"')), F.lit('""'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return {ddl: text, description: F.coalesce(F.col(description), F.lit(""))}
