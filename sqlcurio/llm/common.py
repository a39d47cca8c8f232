"""Shared pieces: tables, written intermediates, apportionment, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Words are runs of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="sqlcurio-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else that of setCheckpointDir().

    Where neither is named a temporary folder serves a local master, as in tests; on a cluster each
    executor would write to its own disk, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return _own_dir(context.applicationId)


#: Stands for a null doc_id, behind all others.
NULL_KEY = (1 << 63) - 1


def document_key(docs: DataFrame) -> tuple[Column, Column]:
    """``key`` and ``tie``: a document is its doc_id and its text (null as empty).

    Documents are put in order by doc_id, null last, then by a hash of the text, so rows that share a
    doc_id, or have none, are told apart by their texts. Only whole numbers are taken.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    known, digest = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # half the hash tells texts of one doc_id apart and is cheaper to shuffle; nulls may be a third of all rows
    tie = F.when(known.isNull(), digest).otherwise(F.shiftrightunsigned(digest, 32))
    return F.coalesce(known, F.lit(NULL_KEY)).alias("key"), tie.alias("tie")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder once and read it back: cuts lineage, survives lost executors.

    Unlike checkpoint() it computes the plan a single time. The folder goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    if (scope := _scope.get()) is not None:
        scope.append(out)
    return out


#: Frames that materialise() gave, with their folders, for discard().
_written: dict[int, tuple[DataFrame, str]] = {}
_scope: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Lists what this thread materialises within, for :func:`discard_all` once its readers are done."""
    outer, mine = _scope.get(), []
    token = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(token)
        if outer is not None:
            outer += mine


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, which nothing reads any more."""
    _, path = _written.pop(id(df))
    files, where = _files(df.sparkSession, path)
    files.delete(where, True)


def discard_all(frames: list[DataFrame], keep: DataFrame | None = None) -> None:
    for df in frames:
        if df is not keep and id(df) in _written:
            discard(df)


def sainte_lague(df: DataFrame, by: list[str], weight: str, seats: str, order: str, out: str) -> DataFrame:
    """Give each group's ``seats`` to its rows by highest quotients weight / (2k + 1).

    Seats whose quotient is sure to be among the highest are given at once; only the quotients
    in a band of about two per row compete, so rows stay linear in the number of parties.
    Ties go to the lower ``order``. Rows of weight zero or null get none.
    """
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    w, b = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.col(seats).cast("double")
    base = (
        df.withColumn("_w", w)
        .withColumn("_v", F.sum("_w").over(group))
        .withColumn("_n", F.sum(F.when(F.col("_w") > 0, 1).otherwise(0)).over(group))
    )
    high = F.col("_v") / (2 * b - F.col("_n"))
    low = F.col("_v") / (2 * b + F.col("_n"))
    count_at = lambda t: F.floor((F.col("_w") / t + 1) / 2).cast("long")
    base = base.withColumn(
        "_sure", F.when((F.col("_w") > 0) & (2 * b > F.col("_n")), F.greatest(count_at(high) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    ).withColumn("_most", F.when((F.col("_w") > 0) & (b > 0), count_at(low) + 1).otherwise(F.lit(0)).cast("long"))
    base = base.withColumn("_open", (b - F.sum("_sure").over(group)).cast("long"))
    keys = [*by, order]
    rivals = base.where("_most > _sure").select(
        *keys, "_w", "_open", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k")
    )
    rank = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)])).orderBy((F.col("_w") / (2 * F.col("_k") + 1)).desc(), F.col(order), F.col("_k"))
    won = rivals.withColumn("_r", F.row_number().over(rank)).where("_r <= _open").groupBy(*keys).agg(F.count("*").alias("_won"))
    same = reduce(lambda x, y: x & y, [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in keys])
    joined = base.alias("_a").join(won.alias("_b"), same, "left")
    return joined.select(*[F.col(f"_a.{c}") for c in df.columns], (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out))


def connected_components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the component's smallest node.

    Alternating large-star and small-star rounds over edges (u, v), u > v; the rounds grow with the
    logarithm of a component's width. Large star: an edge moves its lower end v on to v's lowest
    neighbour. Only nodes that have a lower neighbour are on the other side of that left join, so a
    root with very many edges meets nothing. Small star: u's lower neighbours are tied to the lowest
    of them. Minima are aggregated map-side and written, so that both sides of each join come
    straight from an exchange and AQE can split a node with very many edges. What a round has read
    is deleted after it.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialise(cur, f"{label}-edges")
    stamp = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = stamp(cur)
    for _ in range(most_rounds):
        if not was[0]:
            break
        least = materialise(cur.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), f"{label}-least")
        large = materialise(cur.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), f"{label}-large")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        read, cur = (cur, least, large, lower), materialise(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct(), f"{label}-round")
        for old in read:
            discard(old)
        now = stamp(cur)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
