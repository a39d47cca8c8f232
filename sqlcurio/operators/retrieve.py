"""Nearest neighbours over embeddings, exact, and the vote of the neighbours' models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast at most, and those of a block beyond: 4096 of 1024 doubles are 32 MB.
QUERIES_AT_ONCE = 4096
#: Base vectors of a chunk that a block of queries meets.
ROWS_AT_ONCE = 16384
#: Queries that a task compares with a batch at once: with 10 000 rows some five matrices of 5 MB.
SLICE = 64
#: Names of models that are broadcast at most, and those of a part beyond.
MODELS_AT_ONCE = 4096
#: Groups of queries that a part of the models meets apart.
SALTS = 64


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def score_of(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def candidates(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, base) rows that may be among the k nearest, all ties included.

    Products of norms only choose whom to look at: a row stays unless it is farther than the k-th
    best by more than the rounding of both.
    """
    qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)
    d = qq - 2 * q @ x.T + xx
    rounding = 4 * (q.shape[1] + 4) * np.finfo(float).eps * (qq + xx)
    take = min(k, len(x)) - 1
    bound = np.partition(d + rounding, take, axis=1)[:, take]
    return np.nonzero(~(d - rounding > bound[:, None]))


def first_k(asked: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query, ties by id."""
    order = np.lexsort((ids, d, asked))
    asked, ids, d = asked[order], ids[order], d[order]
    keep = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
    return asked[keep], ids[keep], d[keep]


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, distance squared) of rows that hold the k nearest of each query, SLICE queries at a time."""
    found = []
    for at in range(0, len(q), SLICE):
        asked, near = candidates(q[at : at + SLICE], x, k)
        exact = np.zeros(len(asked))
        for j in range(q.shape[1]):
            exact += (q[asked + at, j] - x[near, j]) ** 2
        found.append(first_k(asked + at, ids[near], exact, k))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float, copy=False)


def _near_few(few: pa.Table, rows: DataFrame, k: int, schema: str) -> DataFrame:
    """Each task's k best rows of each query; the queries, QUERIES_AT_ONCE at most, are broadcast."""
    few = few.combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((few.column(0).combine_chunks(), _matrix(few.column(1).combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = None  # number of the query, base id, distance
        for b in batches:
            if b.num_rows:
                new = nearest(q, _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False), k)
                best = first_k(*(new if best is None else map(np.concatenate, zip(best, new, strict=True))), k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best[0])), pa.array(best[1]), pa.array(best[2])], names=["query", "id", "d2"])

    return rows.mapInArrow(run, schema)


def _near_many(asked: DataFrame, rows: DataFrame, k: int, schema: str) -> DataFrame:
    """The k best rows of each query in each chunk of rows.

    Queries are dealt into blocks and rows into chunks, by hash; every block meets every chunk in a
    group of its own, of about QUERIES_AT_ONCE by ROWS_AT_ONCE vectors, in whatever task Spark chooses.
    """
    blocks = -(-asked.count() // QUERIES_AT_ONCE)
    chunks = max(1, -(-rows.count() // ROWS_AT_ONCE))
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id", "vector"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.withColumn("block", deal(11, blocks)).withColumn("chunk", every(chunks))
    right = rows.withColumn("chunk", deal(12, chunks)).withColumn("block", every(blocks))

    def meet(own: pa.Table, their: pa.Table) -> pa.Table:
        if not own.num_rows or not their.num_rows:
            return pa.table({"query": own.column("id").slice(0, 0), "id": their.column("id").slice(0, 0), "d2": pa.array([], pa.float64())})
        q, x = (_matrix(t.column("vector").combine_chunks()) for t in (own, their))
        number, ids, d = nearest(q, x, their.column("id").to_numpy(), k)
        return pa.table({"query": own.column("id").combine_chunks().take(pa.array(number)), "id": pa.array(ids), "d2": pa.array(d)})

    by = ["block", "chunk"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def knn(queries: DataFrame, base: DataFrame, k: int = 10, query_id: str = "input_id", base_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest base vectors of each query: (query id, base id, distance squared, score, rank).

    Up to QUERIES_AT_ONCE queries are broadcast and ``base`` is read where it lies; each task keeps its
    own k best a query. More queries are dealt into blocks that meet chunks of ``base``, without the
    driver. Either way k rows a query and task (or chunk) are shuffled for ranking, never a pair per
    base row. Ties go to the smaller base id. Null vectors have no neighbours and are none.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("id"), F.col(vector).alias("vector"))
    rows = base.where(F.col(vector).isNotNull()).select(F.col(base_id).alias("id"), F.col(vector).alias("vector"))
    schema = f"query {asked.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, d2 double"
    few = asked.limit(QUERIES_AT_ONCE + 1).toArrow()
    if not few.num_rows:
        found = base.sparkSession.createDataFrame([], schema)
    elif few.num_rows <= QUERIES_AT_ONCE:
        found = _near_few(few, rows, k, schema)
    else:
        found = _near_many(asked, rows, k, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("id").alias(base_id), "d2", score_of(F.col("d2")).alias("score"), "rank")


def _with_every_model(rows: DataFrame, outcomes: DataFrame, query_id: str) -> DataFrame:
    """Each row of ``rows`` once a model of ``outcomes``.

    Names of up to MODELS_AT_ONCE models are broadcast. More are dealt into parts of that size and joined
    by part and by a salt of the query, so that no task holds all queries of a part.
    """
    models = outcomes.select("model").distinct()
    few = models.limit(MODELS_AT_ONCE + 1).toArrow()
    parts = 1
    if few.num_rows <= MODELS_AT_ONCE:
        models = rows.sparkSession.createDataFrame(few, models.schema)
    else:
        parts = -(-models.count() // MODELS_AT_ONCE)
    salts = 1 if parts == 1 else SALTS
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumn("_salt", of(query_id, salts)).withColumn("_part", every(parts))
    right = models.withColumn("_part", of("model", parts)).withColumn("_salt", every(salts))
    return left.join(F.broadcast(right) if parts == 1 else right, ["_part", "_salt"]).drop("_part", "_salt")


def vote(neighbours: DataFrame, outcomes: DataFrame, query_id: str = "input_id", base_id: str = "vec_id") -> DataFrame:
    """Weighted vote: sum(score * success) / sum(score) of each model over a query's neighbours.

    ``outcomes`` (base id, model, success) stays long. A missing outcome counts as failure, and
    every model of the run appears for every query.
    """
    totals = neighbours.groupBy(query_id).agg(F.sum("score").alias("_all"))
    won = neighbours.join(outcomes, base_id).groupBy(query_id, "model").agg(F.sum(F.col("score") * F.col("success")).alias("_won"), F.sum("success").cast("long").alias("sum_score"))
    both = _with_every_model(totals, outcomes, query_id).join(won, [query_id, "model"], "left")
    return both.select(query_id, "model", F.coalesce("sum_score", F.lit(0)).alias("sum_score"), F.coalesce(F.try_divide(F.col("_won"), F.col("_all")), F.lit(0.0)).alias("weighted_score"))


def top_model(votes: DataFrame, query_id: str = "input_id") -> DataFrame:
    own = Window.partitionBy(query_id).orderBy(F.desc("weighted_score"), "model")
    return votes.withColumn("_rank", F.row_number().over(own)).where("_rank = 1").drop("_rank")


def selection_accuracy(chosen: DataFrame, outcomes: DataFrame, query_id: str = "input_id", base_id: str = "vec_id") -> DataFrame:
    """One row: accuracy of the chosen models, and of an oracle that always picks a right one."""
    right = chosen.join(outcomes.select(F.col(base_id).alias(query_id), "model", "success"), [query_id, "model"], "left")
    best = chosen.select(query_id).join(outcomes.groupBy(F.col(base_id).alias(query_id)).agg(F.max("success").alias("any")), query_id, "left")
    a = right.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce("success", F.lit(0)).cast("double")), F.lit(0.0)).alias("accuracy"))
    b = best.agg(F.coalesce(F.avg(F.coalesce("any", F.lit(0)).cast("double")), F.lit(0.0)).alias("oracle_accuracy"))
    return a.join(b)  # one row each


def hit_mix(neighbours: DataFrame, base: DataFrame, column: str, query_id: str = "input_id", base_id: str = "vec_id") -> DataFrame:
    """(value, hits, queries): how many queries have ``hits`` neighbours of a value of ``column``, null among the values."""
    values = base.select(base_id, F.col(column).alias("value"))
    hits = neighbours.select(query_id, base_id).join(values, base_id).groupBy(query_id, "value").agg(F.count("*").alias("hits"))
    return hits.groupBy("value", "hits").agg(F.count("*").alias("queries"))


def success_multiplicity(outcomes: DataFrame, base_id: str = "vec_id") -> DataFrame:
    """How many instances were solved by 0, 1, 2, ... models."""
    return outcomes.groupBy(base_id).agg(F.sum("success").cast("long").alias("solved_by")).groupBy("solved_by").agg(F.count("*").alias("cnt"))


def compare_models(wide: DataFrame, models: list[str]) -> DataFrame:
    """Value counts of each model's 0/1 column."""
    return wide.select(models).unpivot([], models, "model", "value").groupBy("model", "value").agg(F.count("*").alias("cnt"))


def others_only(wide: DataFrame, model: str, others: list[str]) -> DataFrame:
    """Rows that some other model solves and ``model`` does not."""
    return wide.where((F.greatest(*others) == 1 if len(others) > 1 else F.col(others[0]) == 1) & (F.col(model) == 0))
