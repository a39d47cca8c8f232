"""The corpus pipeline: language, near-duplicates, decontamination, mixing, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcurio.llm import decontaminate, langid, mixing, sharding, simhash
from sqlcurio.llm.common import discard_all, document_key, materialise, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a known language: null, empty or letterless texts, and unsure ones.

    Learns from the rows of ``docs`` that have a label; without any no document stays. A null doc_id
    is judged like others. Very long texts are scored whole. Repeated rows all stay or all go; equally
    likely languages go by name. Other columns than those of documents are left out; no rows in, no rows out.
    """
    return langid.keep_known(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the first by doc_id (null last, then by text).

    Rows that repeat doc_id and text are one document, of which one row stays. Null and empty texts
    form one group. Very long texts are hashed whole. Other columns than those of documents are left
    out; no rows in, no rows out.
    """
    return simhash.keep_first(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``; an empty benchmark drops none.

    Null and empty texts hold nothing and stay; null and empty items are held by none. Very long
    texts are read whole. Repeated rows all stay or all go; null ids do no harm. Other columns than
    those of documents are left out; no rows in, no rows out.
    """
    return decontaminate.keep_clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their shares of the words.

    A document is given as often as the mix takes it whole; what is left over gives one more copy
    with the chance of its share, by a seeded hash, so that a source's words stay near its target.
    Null, empty and wordless texts are never taken. A null source is one of its own. Rows are told
    apart by doc_id and text; rows that repeat both get the mean of their shares each. Very long
    texts are given whole, never cut. Other columns than those of documents are left out; no rows
    in, no rows out.
    """
    docs = docs.select(COLUMNS)
    taken = mixing.mix(docs).groupBy("key", "tie").agg(F.max("size").alias("size"), F.avg("taken").alias("taken"))
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(23), "key", "tie"), 11) / F.lit(float(1 << 53))
    whole = F.floor(F.col("taken") / F.col("size"))
    copies = F.when(F.col("size") > 0, whole + (lot * F.col("size") < F.col("taken") - whole * F.col("size")).cast("long")).otherwise(0).cast("int")
    joined = docs.select(*document_key(docs), *COLUMNS).join(taken.select("key", "tie", copies.alias("_copies")), ["key", "tie"])
    return joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, by the Hilbert order of source, language and size.

    Null texts have size 1, null sources and languages lie last on their axes, repeated rows (as the
    mix gives them) and null ids take a slot each. Very long texts count as one row. No rows in, no rows out.
    """
    return sharding.assign_shards(docs.select(COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again; what a stage has read is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    done: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        with scratch() as written:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_all(done + written, keep=docs)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier, XXH64 fingerprints and CGK walks can't be expressed in SQL; the tests hold
#: each stage against brute force or its operator instead.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
