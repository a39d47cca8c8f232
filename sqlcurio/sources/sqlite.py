"""SQLite tables as a Spark source: ranges of row ids are tasks, chosen columns and filters stay in the database."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

#: Row ids of a task, unless there would be more tasks than MOST_TASKS.
ROWS_PER_TASK = 250_000
MOST_TASKS = 10_000
BATCH = 4096

_COMPARISONS = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def name_of(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def kind_of(declared: str) -> T.DataType:
    """The Spark type of a declared one, by SQLite's rules of affinity; numbers of any kind are doubles."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(k in d for k in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType() if any(k in d for k in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()


def connect(options: dict) -> sqlite3.Connection:
    """A read-only connection to the file, or to the copy of it that Spark has brought to this executor."""
    path = SparkFiles.get(options["shipped"]) if options.get("shipped") else options["path"].removeprefix("file://")
    con = sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def columns_of(con: sqlite3.Connection, table: str) -> list[tuple[str, str]]:
    found = [(name, declared or "") for _, name, declared, *_ in con.execute(f"pragma table_info({name_of(table)})")]
    if not found:
        raise ValueError(f"no table {table!r}")
    return found


class SqliteSource(DataSource):
    """``path`` (or ``shipped``, a file given to addFile), ``table``, ``columns`` (a JSON list; all by default), ``rows_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with closing(connect(self.options)) as con:
            known = dict(columns_of(con, self.options["table"]))
        wanted = json.loads(self.options["columns"]) if self.options.get("columns") else list(known)
        if missing := [c for c in wanted if c not in known]:
            raise ValueError(f"no columns {missing} in {self.options['table']!r}")
        return T.StructType([T.StructField(c, kind_of(known[c])) for c in wanted])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


@dataclass
class Rows(InputPartition):
    """Row ids from ``low`` to ``high``; without them the whole table."""

    low: int | None = None
    high: int | None = None


class SqliteReader(DataSourceReader):
    """Values that are not of their column's kind are null, as SQLite columns may hold anything."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.columns = options, schema
        self.kinds = {f.name: f.dataType for f in schema.fields}
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Every pushed condition keeps all rows that its filter keeps; Spark looks again, as stray values may pass."""
        for f in filters:
            self._push(f)
            yield f

    def _push(self, f: Filter) -> None:
        attribute = getattr(f, "attribute", ())
        kind = self.kinds.get(attribute[0]) if len(attribute) == 1 else None
        if not isinstance(kind, (T.LongType, T.DoubleType, T.StringType)):
            return
        text = isinstance(kind, T.StringType)
        own = f"CAST({name_of(attribute[0])} AS TEXT)" if text else name_of(attribute[0])
        fits = lambda v: isinstance(v, str) if text else isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) < 1 << 63
        if isinstance(f, IsNotNull):
            self.where.append(f"{own} IS NOT NULL")
        elif isinstance(f, IsNull) and text:  # stray values of numbers are null as well
            self.where.append(f"{own} IS NULL")
        elif isinstance(f, In) and f.value and len(f.value) <= 500 and all(map(fits, f.value)):
            self.where.append(f"{own} IN ({', '.join('?' * len(f.value))})")
            self.values += f.value
        elif isinstance(f, StringStartsWith) and text:
            self.where.append(f"substr({own}, 1, {len(f.value)}) = ?")
            self.values.append(f.value)
        elif type(f) in _COMPARISONS and fits(f.value) and not (text and type(f) not in (EqualTo, EqualNullSafe) and not f.value.isascii()):
            self.where.append(f"{own} {_COMPARISONS[type(f)]} ?")
            self.values.append(f.value)

    def partitions(self) -> list[Rows]:
        table, per_task = name_of(self.options["table"]), int(self.options.get("rows_per_task", ROWS_PER_TASK))
        with closing(connect(self.options)) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row ids
                return [Rows()]
        if low is None or not isinstance(low, int):
            return [Rows()]
        step = max(per_task, -(-(high - low + 1) // MOST_TASKS))
        return [Rows(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        where, values = list(self.where), list(self.values)
        if rows.low is not None:
            where, values = [*where, "rowid BETWEEN ? AND ?"], [*values, rows.low, rows.high]
        chosen = ", ".join(name_of(f.name) for f in self.columns.fields) or "1"
        sql = f"SELECT {chosen} FROM {name_of(self.options['table'])}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with closing(connect(self.options)) as con:
            cursor = con.execute(sql, values)
            while found := cursor.fetchmany(BATCH):
                columns = list(zip(*found, strict=True))
                arrays = [pa.array([_as(v, f.dataType) for v in c], _ARROW[type(f.dataType)]) for f, c in zip(self.columns.fields, columns, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.columns.fields])


_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}


def _as(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.LongType):
        return value if isinstance(value, int) else None
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) else None
    if isinstance(kind, T.StringType):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    return value if isinstance(value, bytes) else str(value).encode()


def _options(spark: SparkSession, path: str, ship: bool | None) -> dict:
    local = "://" not in path or path.startswith("file://")
    if ship or (ship is None and not (local and spark.sparkContext.master.startswith("local"))):
        spark.sparkContext.addFile(path)
        return {"shipped": path.rstrip("/").rsplit("/", 1)[-1]}
    return {"path": path}


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK, ship: bool | None = None) -> DataFrame:
    """The rows of a table, read by as many tasks as it has ranges of ``rows_per_task`` row ids.

    Only ``columns`` are read; filters over numbers and texts are also put to the database. Every task
    streams its range, so neither the file nor the table is in memory whole. Views and tables without
    row ids are one range. The file must be at ``path`` on all executors, or is shipped: once to each,
    from any store that Spark reads, which is the default unless the master is local.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format(SqliteSource.name()).option("table", table).option("rows_per_task", rows_per_task)
    if columns is not None:
        reader = reader.option("columns", json.dumps(columns))
    return reader.options(**_options(spark, path, ship)).load()


def sqlite_tables(spark: SparkSession, path: str, ship: bool | None = None) -> list[str]:
    """The tables and views of a database."""
    options = _options(spark, path, ship)
    with closing(connect(options)) as con:
        return [t for (t,) in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]


def connect_database(spark: SparkSession, path: str, ship: bool | None = None) -> list[str]:
    """Temporary views of every table of a database, for statements to run over; gives their names."""
    tables = sqlite_tables(spark, path, ship)
    for t in tables:
        sqlite_table(spark, path, t, ship=ship).createOrReplaceTempView("`" + t.replace("`", "``") + "`")
    return tables
