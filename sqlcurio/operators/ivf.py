"""Approximate nearest neighbours: an inverted file of k-means cells, kept on disk by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlcurio.operators.retrieve import knn, score_of, squared_distance
from sqlcurio.operators.shared import written

#: Centroids are broadcast: 4096 of 1024 doubles are 32 MB.
MOST_CELLS = 4096
#: Rows that the cells are fitted on, by hash; every row is indexed.
SAMPLE = 200_000
#: Rows of a block of a cell or of a bundle of small cells, and queries that meet one in one group.
BLOCK = 8192
#: Vectors that a task compares with centroids or with a block at once.
SLICE = 64
#: Probes that a task sorts by bundle at once.
PROBES = 1 << 17
#: int8 steps on either side of a cell's centroid.
STEPS = 127


def _nearest_cells(centroids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` nearest centroids of each vector, SLICE vectors at a time: more cells take no more memory a batch."""
    n, cc = min(n, len(centroids)), (centroids * centroids).sum(1)
    out = np.zeros((len(vectors), n), np.int32)
    for at in range(0, len(vectors), SLICE):
        d = cc - 2 * vectors[at : at + SLICE] @ centroids.T
        if n == 1:
            out[at : at + SLICE, 0] = d.argmin(axis=1)
            continue
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(n), (len(d), 1))
        out[at : at + SLICE] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _bundles(rows: np.ndarray) -> np.ndarray:
    """The bundle of each cell, by the cells' numbers of rows: neighbours in order with a 32nd of all rows, 512 at least and BLOCK at most, together; a larger cell alone."""
    most = min(BLOCK, max(512, int(rows.sum()) // 32))
    out, at, held = np.zeros(len(rows), np.int32), -1, 0
    for k, n in enumerate(rows.tolist()):
        if at < 0 or held + n > most:
            at, held = at + 1, 0
        out[k], held = at, held + n
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def build(base: DataFrame, path: str, cells: int | None = None, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 42) -> None:
    """Writes the index of ``base`` (id, vector) below ``path``: centroids, and the rows by cell.

    Cells, the square root of the rows by default, come from distributed k-means over about ``sample``
    rows chosen by a hash of the id. Every row with a vector then goes to its nearest cell, with its
    difference from the centroid in one byte a component beside the whole vector. Cells with more than
    ``BLOCK`` rows are parted into blocks by hash, so that no cell, however full of copies, is one task's.
    Vectors are of one length and finite; null ones are left out.
    """
    rows = base.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    n = rows.count()
    if not n:
        raise ValueError("no vectors to index")
    wanted = max(2, min(MOST_CELLS, cells or int(n**0.5), n))  # k-means takes two at least
    lot = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, n // sample)))
    some = rows.where(lot == 0).select("vector")
    firsts = some.distinct().limit(2).collect()
    if len(firsts) > 1:
        fitted = KMeans(k=wanted, seed=seed, maxIter=12, featuresCol="features").fit(some.select(array_to_vector("vector").alias("features")))
    centroids = np.array(fitted.clusterCenters() if len(firsts) > 1 else [(firsts or rows.select("vector").take(1))[0]["vector"]])  # copies of one vector are one cell
    spark = base.sparkSession
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vector"))
            cell = _nearest_cells(shared.value, v, 1)[:, 0] if len(v) else np.zeros(0, np.int64)
            apart = v - shared.value[cell]
            step = np.maximum(np.abs(apart).max(axis=1, initial=0) / STEPS, np.finfo(float).tiny)
            code = np.rint(apart / step[:, None]).astype(np.int8)
            columns = [b.column("id"), b.column("vector"), pa.array(cell.astype(np.int32)), pa.array(step), pa.array(list(map(bytes, code)), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "cell", "step", "code"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"id {kind}, vector array<double>, cell int, step double, code binary")
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    counts = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"))
    counts.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    if table.num_rows > MOST_CELLS:
        raise ValueError("too many cells")
    return table.column("cell").to_numpy(), _matrix(table.column("centroid").combine_chunks())


def probes(queries: DataFrame, path: str, n_probe: int, query_id: str = "input_id", vector: str = "embedding") -> DataFrame:
    """(query, vector, cell): the ``n_probe`` cells nearest to each query. Centroids go to the tasks, queries stay where they are."""
    shared = queries.sparkSession.sparkContext.broadcast(_centroids(queries.sparkSession, path))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centroids = shared.value
        for b in batches:
            if b.num_rows:
                near = cells[_nearest_cells(centroids, _matrix(b.column("vector")), n_probe)]
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("vector"), pa.array(list(near), pa.list_(pa.int32()))], names=["query", "vector", "cells"])

    found = asked.mapInArrow(run, f"query {asked.schema['query'].dataType.simpleString()}, vector array<double>, cells array<int>")
    return found.select("query", "vector", F.posexplode("cells").alias("place", "cell"))


def tuned_probes(queries: DataFrame, base: DataFrame, path: str, k: int = 10, target: float = 0.97, sample: int = 256, query_id: str = "input_id", base_id: str = "vec_id", vector: str = "embedding") -> int:
    """How many cells of the index must be probed so that ``target`` of the ``k`` nearest lie in them.

    Measured on about ``sample`` queries chosen by hash: their exact neighbours are looked up in the
    index, and the place of each neighbour's cell in its query's order of cells says how many probes
    find it. Vectors without clusters need most cells, clustered ones few.
    """
    n = queries.where(F.col(vector).isNotNull()).count()
    some = queries.where(F.pmod(F.xxhash64(F.lit(9), query_id), F.lit(max(1, n // sample))) == 0)
    exact = knn(some, base, k, query_id, base_id, vector).select(F.col(query_id).alias("query"), F.col(base_id).alias("id"))
    rows = queries.sparkSession.read.parquet(f"{path}/rows").select("id", "cell")
    order = probes(some, path, MOST_CELLS, query_id, vector).select("query", "cell", "place")
    places = rows.join(F.broadcast(exact), "id").join(order, ["query", "cell"])
    needed = places.agg(F.expr(f"percentile_disc({target}) WITHIN GROUP (ORDER BY place)").alias("p")).first()["p"]
    return 1 if needed is None else int(needed) + 1


def _asked(queries: DataFrame, shared: Broadcast, n_probe: int, query_id: str, vector: str) -> DataFrame:
    """(query, vector, found): a query's ``n_probe`` nearest cells, listed by the bundle they are in."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centroids, bundle = shared.value
        for batch in batches:
            some = max(1, PROBES // min(n_probe, len(cells)))
            for at in range(0, batch.num_rows, some):
                b = batch.slice(at, some)
                near = _nearest_cells(centroids, _matrix(b.column("vector")), n_probe)
                who, place = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                there = bundle[place] >= 0  # a cell without rows is in none
                who, place = who[there], place[there]
                order = np.lexsort((place, bundle[place], who))
                who, place = who[order], place[order]
                starts = np.flatnonzero(np.diff(who, prepend=-1) | np.diff(bundle[place], prepend=-1))
                lists = pa.ListArray.from_arrays(np.append(starts, len(who)).astype(np.int32), pa.array(cells[place].astype(np.int32)))
                found = pa.StructArray.from_arrays([pa.array(bundle[place[starts]].astype(np.int32)), lists], names=["bundle", "cells"])
                of = np.searchsorted(who[starts], np.arange(len(near) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("vector"), pa.ListArray.from_arrays(of, found)], names=["query", "vector", "found"])

    return asked.mapInArrow(run, f"query {asked.schema['query'].dataType.simpleString()}, vector array<double>, found array<struct<bundle:int,cells:array<int>>>")


def _possible(q: np.ndarray, x: np.ndarray, error: np.ndarray, may: np.ndarray, ids: np.ndarray, k: int, keep: int) -> tuple[np.ndarray, ...]:
    """(query, row, distance squared by codes, least and most that the distance can be) of rows that may be among the k nearest.

    A row's code is ``error`` away from its vector at most. Rows that are farther than the k-th best for
    certain go, and those behind the ``keep`` best by codes, ties by id.
    """
    qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)
    d = qq - 2 * q @ x.T + xx
    rounding = 4 * (q.shape[1] + 4) * np.finfo(float).eps * (qq + xx)
    d[~may] = np.inf
    far = np.sqrt(np.maximum(d + rounding, 0)) + error
    low = np.sqrt(np.maximum(d - rounding, 0)) - error
    best = lambda m, n: np.partition(m, n - 1, axis=1)[:, n - 1 : n] if n < m.shape[1] else np.inf
    who, which = np.nonzero(may & (low <= best(far, k)) & (d <= best(d, keep)))
    near = d[who, which]
    order = np.lexsort((ids[which], near, who))
    order = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < keep]
    who, which = who[order], which[order]
    return who, which, near[order], low[who, which], far[who, which]


def search(queries: DataFrame, path: str, k: int = 10, n_probe: int = 16, oversample: int = 4, query_id: str = "input_id", base_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query id, base id, d2, score, rank): the ``k`` nearest of the rows in each query's ``n_probe`` nearest cells.

    Small cells are bundled and large ones parted into blocks; queries meet them in groups of bounded
    size. Of the ``k`` times ``oversample`` best by one-byte codes a group gives those that may be among
    the ``k`` nearest, which the size of a code's error decides: not many more than ``k`` a query, however
    many are asked for. Those of all groups are held against their common bound, joined to their whole
    vectors and ranked exactly, ties by the smaller id. Only probed cells are read: they prune the
    partitions of the index. With every cell probed and all rows oversampled the result is that of an
    exact search; its work grows with queries times rows, what is shuffled by a ``BLOCK``-th part of that.
    """
    spark, keep = queries.sparkSession, k * oversample
    rows = spark.read.parquet(f"{path}/rows")
    numbers, centroids = _centroids(spark, path)
    sizes = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # at most MOST_CELLS rows, as centroids
    own, n = sizes.column("cell").to_numpy(), sizes.column("n").to_numpy()
    bundle = np.full(len(numbers), -1, np.int32)
    bundle[np.searchsorted(numbers, own)] = _bundles(n)
    shared = spark.sparkContext.broadcast((numbers, centroids, bundle))
    asked = written(_asked(queries, shared, n_probe, query_id, vector), "ivf-probes")
    apart = asked.select("query", "vector", F.inline("found"))
    probed = F.broadcast(asked.select(F.inline("found")).select(F.explode("cells").alias("cell")).distinct())  # at most MOST_CELLS numbers
    blocks = spark.createDataFrame([(int(c), int(b), -(-int(m) // BLOCK)) for c, b, m in zip(own, _bundles(n), n, strict=True)], "cell int, bundle int, blocks int")
    parts = apart.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    plan = F.broadcast(blocks.join(parts, "bundle"))
    wide = F.broadcast(blocks.groupBy("bundle").agg(F.max("blocks").alias("blocks")).join(parts, "bundle"))
    block = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.col("blocks")).cast("int")
    part = lambda c: F.pmod(F.xxhash64(F.lit(8), c), F.col("parts")).cast("int")
    left = rows.join(probed, "cell", "left_semi").select("cell", "id", "step", "code").join(plan, "cell").withColumn("block", block("id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
    right = apart.join(wide, "bundle").withColumn("part", part("query")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts")
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, cell int, id {rows.schema['id'].dataType.simpleString()}, near double, low double, far double"

    def meet(own: pa.Table, their: pa.Table) -> pa.Table:
        asked, ids, cell = their.column("query").combine_chunks(), own.column("id").combine_chunks(), own.column("cell").to_numpy()
        if not own.num_rows or not their.num_rows:
            return pa.table({"query": asked.slice(0, 0), "cell": pa.array([], pa.int32()), "id": ids.slice(0, 0)} | {c: pa.array([], pa.float64()) for c in ("near", "low", "far")})
        numbers, centroids, _ = shared.value
        there, place = np.unique(cell, return_inverse=True)
        middle = centroids[np.searchsorted(numbers, there)]
        step, shift = own.column("step").to_numpy(), middle.mean(axis=0)
        code = np.frombuffer(b"".join(own.column("code").to_pylist()), np.int8).reshape(len(cell), -1)
        x = (middle - shift)[place] + code * step[:, None]
        q = _matrix(their.column("vector").combine_chunks())
        slack = 16 * np.finfo(float).eps * max(np.abs(q).max(), np.abs(middle).max())  # of the sums and differences of components
        q, error = q - shift, (step * (0.5 + 1e-6) + slack) * x.shape[1] ** 0.5
        lists = their.column("cells").combine_chunks()
        who, at = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        spot = np.minimum(np.searchsorted(there, at), len(there) - 1)
        wanted = np.zeros((len(q), len(there)), bool)
        wanted[who[there[spot] == at], spot[there[spot] == at]] = True
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable").argsort()  # ids of any type, by rank
        found = []
        for first in range(0, len(q), SLICE):
            who, *rest = _possible(q[first : first + SLICE], x, error, wanted[first : first + SLICE][:, place], order, k, keep)
            found.append((who + first, *rest))
        who, which, near, low, far = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query": asked.take(pa.array(who)), "cell": pa.array(cell[which].astype(np.int32)), "id": ids.take(pa.array(which)), "near": near, "low": low, "far": far})

    by, each = ["bundle", "block", "part"], Window.partitionBy("query")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, kinds)
    bound = F.max(F.when(F.col("_far") <= k, F.col("far"))).over(each)
    able = met.withColumn("_far", F.row_number().over(each.orderBy("far", "id"))).withColumn("_bound", bound).where("low <= _bound")
    best = able.withColumn("_place", F.row_number().over(each.orderBy("near", "id"))).where(F.col("_place") <= keep).select("query", "cell", "id")
    whole = rows.select("cell", "id", F.col("vector").alias("_there")).join(probed, "cell", "left_semi")
    exact = best.join(whole, ["cell", "id"]).join(asked.select("query", F.col("vector").alias("_here")), "query").withColumn("d2", squared_distance(F.col("_here"), F.col("_there")))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("id").alias(base_id), "d2", score_of(F.col("d2")).alias("score"), "rank")


def recall(found: DataFrame, exact: DataFrame, query_id: str = "input_id", base_id: str = "vec_id") -> DataFrame:
    """One row: how many of the exact neighbours were found, and their share."""
    hits = exact.join(found.select(query_id, base_id, F.lit(1).alias("_hit")), [query_id, base_id], "left")
    return hits.agg(F.count("*").alias("n"), F.count("_hit").alias("hits"), F.coalesce(F.try_divide(F.count("_hit"), F.count("*")), F.lit(1.0)).alias("recall"))
