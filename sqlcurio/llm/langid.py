"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sqlcurio.llm.common import materialise

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 15
#: Documents a language gives to the training sample, on average at most.
SAMPLE_PER_LANG = 5000
#: Languages of a block of the model: at most 8 MB of log probabilities, and two million counts on the driver.
LANGS_AT_ONCE = 64
ALPHA = 0.5
#: A score counts at most this many n-grams' worth of evidence, so that long texts don't all score 1.
MOST_EVIDENCE = 200
#: Labels whose shares are broadcast, a few MB.
MOST_BROADCAST = 50_000
#: Characters times languages that are scored at once.
SCORES_AT_ONCE = 1 << 22

_LETTER = regex.compile(r"\p{L}")


class Model(NamedTuple):
    """A block of the model; the languages of all blocks are in the order of their names."""

    langs: list[str]
    prior: np.ndarray  # log prior by language
    matrix: np.ndarray  # log probabilities, a row per hash bucket


def ngram_buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash bucket of each n-gram of ``order`` characters, in order."""
    h = np.full(len(codes) - order + 1, order, np.uint64)
    for k in range(order):
        h = (h ^ codes[k : len(codes) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one blank for each run of ASCII non-letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    plain = (codes < 0x80) & ~((codes >= 97) & (codes <= 122))
    codes = np.where(plain, np.uint64(32), codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~((codes[1:] == 32) & (codes[:-1] == 32))
    return np.concatenate([[np.uint64(32)], codes[keep], [np.uint64(32)]]) if len(codes) else np.zeros(0, np.uint64)


def pieces(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Slices whose first ``size`` places start every n-gram once; what lies behind completes them."""
    for at in range(0, len(codes), size):
        yield codes[at : at + size + max(ORDERS) - 1]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> list[Model]:
    """Fit on (doc_id, text, lang): a hash-chosen sample of at most about ``sample_per_lang`` rows a language.

    N-gram counts are summed on the executors. The driver gets a row per language, and then the
    counts of LANGS_AT_ONCE languages at a time; every label is learned, however many there are.
    """
    spark = labelled.sparkSession
    sizes = labelled.where("lang is not null and text is not null").groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in sizes.collect()}
    if not sizes:
        return []
    share = spark.createDataFrame([(k, min(1.0, sample_per_lang / n)) for k, n in sizes.items()], "lang string, _share double")
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11) / F.lit(float(1 << 53))
    if len(sizes) <= MOST_BROADCAST:  # else rows are shuffled by label
        share = F.broadcast(share)
    sample = labelled.where("text is not null").join(share, "lang").where(lot < F.col("_share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, row in seen.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "bucket", "n"])
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang not in seen and len(seen) == LANGS_AT_ONCE:
                    yield from counted()
                row = seen.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for part in pieces(codes_of(text.as_py()), SCORES_AT_ONCE):
                    for order in ORDERS:
                        if len(part) >= order:
                            row += np.bincount(ngram_buckets(part, order)[:SCORES_AT_ONCE], minlength=1 << BUCKET_BITS)
        yield from counted()

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs, everything = sorted(sizes), sum(sizes.values())
    if len(langs) > LANGS_AT_ONCE:
        counts = materialise(counts, "langid-counts")
    models = []
    for at in range(0, len(langs), LANGS_AT_ONCE):
        block = langs[at : at + LANGS_AT_ONCE]
        own = counts.where((F.col("lang") >= block[0]) & (F.col("lang") <= block[-1])).toPandas()
        block = [x for x in block if x in set(own["lang"])]  # texts without n-grams teach nothing
        if block:
            table = np.full((1 << BUCKET_BITS, len(block)), ALPHA)
            table[own["bucket"].to_numpy(), np.searchsorted(block, own["lang"].to_numpy(str))] += own["n"].to_numpy()
            models.append(Model(block, np.log(np.array([sizes[x] for x in block], float) / everything), np.log(table / table.sum(axis=0)).astype(np.float32)))
    return models


class Scores(NamedTuple):
    lang: np.ndarray  # best language of the block, None where a text can have none
    best: np.ndarray  # its log likelihood, prior included
    tempered: np.ndarray  # the same with bounded evidence
    all: np.ndarray  # log of the sum of all languages' tempered likelihoods


def score_texts(texts: list[str | None], model: Model) -> Scores:
    """Best language of the block for whole texts, and what its tempered posterior is made of.

    A batch is one sparse matrix, documents by buckets, kept as bucket lists and row starts; its
    product with the log-probability matrix is a gather and a segmented sum.
    """
    held: list[np.ndarray] = []
    owners: list[int] = []
    total = np.zeros((len(texts), len(model.langs)))
    grams = np.zeros(len(texts), np.int64)
    at_once = max(1024, SCORES_AT_ONCE // len(model.langs))

    def flush() -> None:
        if not held:
            return
        codes, lengths = np.concatenate(held), np.array([len(x) for x in held])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for order in ORDERS:
            buckets = ngram_buckets(codes, order) if len(codes) >= order else np.zeros(0, np.int32)
            sums = np.zeros((len(codes) + 1, len(model.langs)))
            np.cumsum(model.matrix[buckets], axis=0, dtype=np.float64, out=sums[1 : len(buckets) + 1])
            ends = starts + np.clip(lengths - order + 1, 0, at_once)
            np.add.at(total, owners, sums[ends] - sums[starts])
            np.add.at(grams, owners, ends - starts)
        held.clear()
        owners.clear()

    waiting, known = 0, np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        if text and _LETTER.search(text):
            known[k] = True
            for part in pieces(codes_of(text), at_once):
                held.append(part)
                owners.append(k)
                waiting += len(part)
                if waiting >= at_once:
                    flush()
                    waiting = 0
    flush()
    likely = total + model.prior
    best = np.argmax(likely, axis=1)[:, None]
    tempered = total * np.minimum(1.0, MOST_EVIDENCE / np.maximum(grams, 1))[:, None] + model.prior
    langs = np.where(known, np.array(model.langs, object)[best[:, 0]], None)
    return Scores(langs, np.take_along_axis(likely, best, 1)[:, 0], np.take_along_axis(tempered, best, 1)[:, 0], np.logaddexp.reduce(tempered, axis=1))


def merged(old: Scores, new: Scores) -> Scores:
    """Of two blocks; the earlier one, with the earlier names, wins ties."""
    better = new.best > old.best
    return Scores(*[np.where(better, y, x) for x, y in zip(old[:3], new[:3], strict=True)], np.logaddexp(old.all, new.all))


def scored(docs: DataFrame, models: list[Model], keep: list[str]) -> tuple[DataFrame, Column, Column]:
    """``docs`` with the columns ``keep`` and scores, and the expressions of language and score over it.

    Each block of the model is broadcast and is one pass over the batches, within the same stage.
    """
    free = "_" * (1 + max(map(len, docs.columns)))
    names = [free + c for c in Scores._fields]
    if not models:
        return docs.select(*[F.col(f"`{c}`") for c in keep]), F.lit(UNKNOWN), F.lit(0.0)
    plain = list(docs.schema)
    types = [pa.string(), pa.float64(), pa.float64(), pa.float64()]
    at = docs.columns.index("text")
    for number, model in enumerate(models):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        kept = [f for f in plain if number < len(models) - 1 or f.name in keep]
        places = [plain.index(f) for f in kept]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number, places=places, kept=kept) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                now = score_texts(b.column(at).to_pylist(), shared.value)
                if number:
                    now = merged(Scores(*[c.to_numpy(zero_copy_only=False) for c in b.columns[-4:]]), now)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in places], *[pa.array(x, t) for x, t in zip(now, types, strict=True)]], names=[*[f.name for f in kept], *names])

        schema = StructType([*kept, StructField(names[0], StringType()), *[StructField(c, DoubleType()) for c in names[1:]]])
        docs = docs.mapInArrow(run, schema)
    lang = F.col(names[0])
    score = F.when(lang.isNull(), 0.0).otherwise(F.least(F.exp(F.col(names[2]) - F.col(names[3])), F.lit(1.0)))
    return docs, F.coalesce(lang, F.lit(UNKNOWN)), score


def learned(docs: DataFrame, sample_per_lang: int) -> list[Model]:
    learn = docs.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    return train(learn.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), sample_per_lang)


def identify(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, trained on those rows of ``docs`` (doc_id, text, lang) not held out.

    Held out: crc32 of doc_id as text leaves 2 modulo 4. ``und`` with score 0 for null text, text
    without letters, and everything where no row has a label. Of equally likely languages the first
    by name wins. A null doc_id is neither held out nor learned from. Repeated rows are all judged.
    Very long texts are read in pieces that share their sums. Other columns are ignored; no rows in,
    no rows out. Every label is learned: the model travels in blocks of LANGS_AT_ONCE languages.
    """
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    found, lang, score = scored(rows, learned(docs, sample_per_lang), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", lang.alias("lang_pred"), score.alias("score"))


def keep_known(docs: DataFrame, least_score: float = 0.5, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """The rows of ``docs``, whole, whose language is known with at least ``least_score``; no shuffle.

    Null, empty and letterless texts go, and everything where no row has a label. The rest is as in :func:`identify`.
    """
    found, lang, score = scored(docs, learned(docs, sample_per_lang), docs.columns)
    return found.where((lang != UNKNOWN) & (score >= least_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
