"""Execution accuracy at scale: every distinct statement runs once and leaves an order-free fingerprint of its result."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlcurio.operators.shared import shared_path

# Reasons that results carry.
OTHER_COLUMNS = "Results have different column sets"
OTHER_ROWS = "Results have different rows"
GOLD_FAILED = "Ground truth execution error: "
FAILED = "Execution error: "
UNREADABLE = "only SELECT and WITH are run"

#: Statements that run at the same time, in a scheduler pool of their own.
AT_ONCE = 8
#: Seconds after which a statement's jobs are cancelled.
SECONDS = 300.0
#: Finished statements that the driver holds before it writes them.
BATCH = 256

RESULT = "statement string, error string, n_columns int, n_rows long, n_distinct long, row_sum string, bag_sum string"
_WRITES = re.compile(r"\b(?:insert\s+(?:into|overwrite)|delete\s+from|merge\s+into|update\s+\S+\s+set)\b", re.IGNORECASE)


def readable(sql: str) -> bool:
    """Only single reading statements are run; quoted text doesn't count."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL)
    return bool(re.match(r"(?is)[\s(]*(?:SELECT|WITH)\b", bare)) and ";" not in bare.strip().rstrip(";") and not _WRITES.search(bare)


def statement_of(sql: Column) -> Column:
    """What makes two texts one statement: blanks around it and a last semicolon don't count."""
    return F.regexp_replace(F.trim(F.regexp_replace(sql, r"\A\s+|[\s;]+\z", "")), r"\A;+", "")


def canonical(value: Column, kind: T.DataType) -> Column:
    """A string that is equal for equal values of whatever width: 1, 1.0 and true are one, '1' is another."""
    plain = lambda d: F.when(d == 0, "0").otherwise(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"))
    number = lambda d: F.regexp_replace(plain(d), r"\.$", "")
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        text = F.concat(F.lit("n"), value.cast("long").cast("string") if not isinstance(kind, T.BooleanType) else value.cast("int").cast("string"))
    elif isinstance(kind, T.DecimalType):
        text = F.concat(F.lit("n"), number(F.coalesce(value.try_cast("decimal(38,18)"), value)))
    elif isinstance(kind, T.FractionalType):
        x = value.cast("double")
        # shortest digits, without an exponent where the decimal holds them all
        text = F.concat(F.lit("n"), F.when(F.isnan(x) | (F.abs(x) >= 1e19) | ((F.abs(x) < 1e-12) & (x != 0)), x.cast("string")).otherwise(number(x.try_cast("decimal(38,18)"))))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("t"), F.unix_micros(value.cast("timestamp")).cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("b"), F.hex(value))
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = F.concat(F.lit("s"), value.cast("string"))
    else:
        text = F.concat(F.lit("j"), value.cast("string"))
    return F.coalesce(text, F.lit("x"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row for the whole result: n_columns, n_rows, n_distinct, row_sum over distinct rows, bag_sum with multiplicities.

    Columns count by position, rows in any order, nulls are equal. Rows shrink to two 64-bit hashes
    before the shuffle; sums of hashes do not depend on partitions or order.
    """
    named = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    values = [canonical(F.col(f.name), f.dataType) for f in named.schema.fields]
    hashed = named.select(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string")
    both = lambda *h: F.concat_ws(":", *map(total, h))
    return hashed.agg(
        F.lit(len(df.columns)).alias("n_columns"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"),
        both(F.col("a"), F.col("b")).alias("row_sum"), both(F.xxhash64("a", "b", "n"), F.xxhash64("b", "a", "n")).alias("bag_sum"),
    )


class Watch:
    """Cancels the jobs of statements that run longer than they may, until they end."""

    def __init__(self, spark: SparkSession, seconds: float) -> None:
        self.context, self.seconds, self.running, self.over = spark.sparkContext, seconds, {}, set()
        self.lock, self.ended = threading.Lock(), threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def __enter__(self) -> Watch:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.thread.join()

    def _run(self) -> None:
        while not self.ended.wait(min(0.2, self.seconds / 4)):
            with self.lock:
                late = [group for group, began in self.running.items() if time.monotonic() - began > self.seconds]
                self.over.update(late)
            for group in late:  # again each time: a statement may start further jobs
                self.context.cancelJobGroup(group)

    def begin(self, group: str) -> None:
        with self.lock:
            self.running[group] = time.monotonic()

    def end(self, group: str) -> bool:
        """Whether its time was over."""
        with self.lock:
            self.running.pop(group, None)
            return group in self.over


def _run_one(spark: SparkSession, statement: str, watch: Watch, pool: str) -> tuple:
    failed = lambda why: (statement, why, None, None, None, None, None)
    if not readable(statement):
        return failed(UNREADABLE)
    context, group = spark.sparkContext, f"statement-{uuid.uuid4().hex}"
    context.setJobGroup(group, statement[:200], interruptOnCancel=True)
    context.setLocalProperty("spark.scheduler.pool", pool)
    watch.begin(group)
    try:
        row = fingerprint(spark.sql(statement)).first()
        return (statement, None, *row)
    except Exception as e:  # any failure of foreign SQL is a verdict
        why = str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__
        return failed(f"cancelled after {watch.seconds:g} s" if watch.end(group) else why)
    finally:
        watch.end(group)


def _results(spark: SparkSession, statements: Iterator[str], at_once: int, seconds: float, pool: str) -> Iterator[tuple]:
    with Watch(spark, seconds) as watch, ThreadPoolExecutor(at_once) as workers:
        open_: set[Future] = set()
        for statement in statements:
            open_.add(workers.submit(_run_one, spark, statement, watch, pool))
            if len(open_) >= 2 * at_once:
                done, open_ = wait(open_, return_when=FIRST_COMPLETED)
                yield from (f.result() for f in done)
        for f in open_:
            yield f.result()


def run_statements(statements: DataFrame, session: SparkSession | None = None, at_once: int = AT_ONCE, seconds: float = SECONDS, pool: str = "statements") -> DataFrame:
    """(statement, error, n_columns, n_rows, n_distinct, row_sum, bag_sum) of every distinct statement of the first column.

    A statement is one Spark query over the views of ``session`` (by default that of ``statements``), under a job group of its own: ``at_once``
    of them run together, in the scheduler's ``pool`` (fair where ``spark.scheduler.mode`` is), and a
    statement that runs over ``seconds`` is cancelled and says so in ``error``, as any failure does.
    Statements come to the driver a partition at a time and results leave it a batch at a time, to a
    written table, so the driver holds neither all. Results stay where they are computed but for one
    row of sums. Null and empty statements are left out.
    """
    spark = statements.sparkSession
    only = statements.select(statement_of(F.col(f"`{statements.columns[0]}`").cast("string")).alias("statement")).where("statement <> ''").distinct()
    path = shared_path(spark, "statements")
    spark.createDataFrame([], RESULT).write.parquet(path)
    batch: list[tuple] = []
    keep = lambda rows: spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("append").parquet(path)
    for row in _results(session or spark, (r[0] for r in only.toLocalIterator()), at_once, seconds, pool):
        batch.append(row)
        if len(batch) == BATCH:
            keep(batch)
            batch = []
    if batch:
        keep(batch)
    return spark.read.schema(RESULT).parquet(path)


def verdicts(predictions: DataFrame, results: DataFrame, gold: str = "sql", predicted: str = "generated_sql", bag: bool = False) -> DataFrame:
    """``predictions`` with execution_correct and execution_error by equi-joins with ``results`` on both statements.

    Both are null where a statement is missing. Results are equal if their fingerprints are: as sets of
    rows, or with ``bag`` with multiplicities.
    """
    kept = predictions.drop("execution_correct", "execution_error")
    sides = {side: results.select(F.col("statement").alias(f"_{side}"), F.struct("error", "n_columns", "n_distinct", "n_rows", "row_sum", "bag_sum").alias(f"_{side}_is")) for side in ("gold", "predicted")}
    keyed = kept.withColumn("_gold", statement_of(F.col(gold))).withColumn("_predicted", statement_of(F.col(predicted)))
    joined = keyed.join(sides["gold"], "_gold", "left").join(sides["predicted"], "_predicted", "left")
    g, p = F.col("_gold_is"), F.col("_predicted_is")
    same = (g["n_rows"] == p["n_rows"]) & (g["bag_sum"] == p["bag_sum"]) if bag else (g["n_distinct"] == p["n_distinct"]) & (g["row_sum"] == p["row_sum"])
    why = (
        F.when(g["error"].isNotNull(), F.concat(F.lit(GOLD_FAILED), g["error"])).when(p["error"].isNotNull(), F.concat(F.lit(FAILED), p["error"]))
        .when(g["n_columns"] != p["n_columns"], OTHER_COLUMNS).when(~same, OTHER_ROWS)
    )
    out = joined.withColumn("_why", F.when(g.isNotNull() & p.isNotNull(), why))
    return out.select(*kept.columns, F.when(g.isNotNull() & p.isNotNull(), F.col("_why").isNull()).alias("execution_correct"), F.col("_why").alias("execution_error"))


def check_executions(predictions: DataFrame, gold: str = "sql", predicted: str = "generated_sql", bag: bool = False, session: SparkSession | None = None, at_once: int = AT_ONCE, seconds: float = SECONDS) -> DataFrame:
    """``predictions`` with execution_correct and execution_error, over the views of ``session`` (its own by default).

    Gold and predicted statements are one set: what many pairs share runs once. Pairs with a missing
    side run neither of theirs.
    """
    both = predictions.where(f"coalesce(`{gold}`, '') <> '' and coalesce(`{predicted}`, '') <> ''")
    statements = both.select(F.explode(F.array(gold, predicted)).alias("statement"))
    results = run_statements(statements, session, at_once, seconds)
    return verdicts(predictions, results, gold, predicted, bag)
