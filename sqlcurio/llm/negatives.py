"""Hard negatives by a vector-approximation file: cells of each dimension bound a score before it is computed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlcurio.llm.common import materialise

#: Cells of each dimension; a cell is one byte of a row's approximation.
CELLS = 64
#: Rows whose quantiles place the edges of the cells; outer edges are the extremes of all rows.
SAMPLE = 10_000
#: Anchors that travel to the tasks at once, about 1 MB for every 32 components.
ANCHORS_AT_ONCE = 8192
#: Anchors and rows that are bounded in one product.
SLICE = 1024
#: Components beyond it, either way, count as it, so that a score of 128 of them fits 64 bits.
LARGEST = 1 << 28

ROW = "id long, name long, label long, v array<int>, code binary"


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(id, name, label, v) of the distinct rows of ``rows`` (id, label, vector) that take part.

    Rows with a null, or with a null or non-finite component, take none. ``name`` hashes a row, so
    rows that share an id but differ are told apart.
    """
    whole = F.transform("vector", lambda x: F.floor(F.least(F.greatest(F.lit(scale) * x.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.where("id is not null and label is not null and vector is not null").where(finite)
    found = known.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("v")).distinct()
    return found.withColumn("name", F.xxhash64("id", "label", "v"))


def cell_edges(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest value of every cell, (dimensions, cells) each.

    Inner edges are quantiles of about ``sample`` rows taken by their hash; the outer ones are the
    extremes of all rows. Shorter vectors end in zeros, so zero counts where lengths differ.
    """
    n, width, narrow = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    ends = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").toArrow()
    low, high = (ends.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
    low[narrow:], high[narrow:] = np.minimum(low[narrow:], 0), np.maximum(high[narrow:], 0)
    some = matrix(rows.where(F.pmod("name", F.lit(max(1, n // sample))) == 0).select("v").toArrow().column("v"), width)
    some = some if len(some) else low[None]
    inner = np.sort(np.clip(np.quantile(some, np.linspace(0, 1, cells + 1)[1:-1], axis=0).T.round().astype(np.int64), low[:, None], high[:, None]), axis=1)
    below = np.concatenate([low[:, None], inner], axis=1)
    # a cell whose edge is the next one's holds nothing; its bounds then are that edge
    return below, np.maximum(np.concatenate([inner - 1, high[:, None]], axis=1), below)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def with_codes(rows: DataFrame, below: np.ndarray) -> DataFrame:
    """``rows`` with the approximation of each vector, one byte a dimension."""
    width = len(below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), width)
            code = np.stack([np.searchsorted(below[d, 1:], v[:, d], "right") for d in range(width)], axis=1).astype(np.uint8) if width else np.zeros((len(v), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("name"), b.column("label"), b.column("v"), pa.array(list(map(bytes, code)), pa.binary())], names=["id", "name", "label", "v", "code"])

    return rows.select("id", "name", "label", "v").mapInArrow(run, ROW)


class Bounds:
    """Lower and upper bounds of the scores of anchors against rows that are known by their cells."""

    def __init__(self, anchors: np.ndarray, below: np.ndarray, above: np.ndarray) -> None:
        self.below, self.above, self.at = below, above, np.arange(len(below))
        most = len(below) * float(np.abs(anchors).max(initial=0)) * float(max(np.abs(below).max(initial=0), np.abs(above).max(initial=0)))
        # sums of whole numbers below these are exact in any order; beyond, bounds are widened by the rounding
        self.kind = np.float32 if most < 1 << 24 else np.float64
        self.slack = 0.0 if most < 1 << 53 else most * 2.0**-48
        self.signed = np.concatenate([np.maximum(anchors, 0), np.minimum(anchors, 0)], axis=1).astype(self.kind)

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.below[self.at, code].astype(self.kind), self.above[self.at, code].astype(self.kind)
        return np.concatenate([low, high], axis=1).T, np.concatenate([high, low], axis=1).T

    def between(self, which: np.ndarray | slice, edges: tuple[np.ndarray, np.ndarray], rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        q = self.signed[which]
        return q @ edges[0][:, rows] - self.slack, q @ edges[1][:, rows] + self.slack


class Best:
    """The k best rows of each group: higher scores first, ties by id, then name."""

    def __init__(self, groups: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.held = k, tuple(np.zeros(0, np.int64) for _ in range(4))  # group, score, id, name
        self.least = np.full(groups, np.iinfo(np.int64).min) if floor is None else floor.copy()

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, name: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i, n = (np.concatenate(x) for x in zip(self.held, (group, score, ids, name), strict=True))
        order = np.lexsort((n, i, -s, g))
        g, s, i, n = g[order], s[order], i[order], n[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        keep = place < self.k
        full = place == self.k - 1
        self.least[g[full]] = s[full]  # what scores less can't enter any more
        self.held = g[keep], s[keep], i[keep], n[keep]


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        if b.num_rows:
            code = np.frombuffer(b.column("code").cast(pa.binary(width)).buffers()[1], np.uint8, b.num_rows * width).reshape(-1, width) if width else np.zeros((b.num_rows, 0), np.uint8)
            yield code, matrix(b.column("v"), width), *(b.column(c).to_numpy() for c in ("label", "id", "name"))


def _exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", q[a[part]], x[r[part]])
    return out


def positives(approximated: DataFrame, anchors: pa.Table, edges: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(anchor, name, id, other, score): of each task the k best other rows of an anchor's label.

    A row is scored only if its upper bound reaches the anchor's k-th best score or lower bound so far.
    """
    width = len(edges[0])
    shared = approximated.sparkSession.sparkContext.broadcast((matrix(anchors.column("v"), width), *(anchors.column(c).to_numpy() for c in ("label", "id", "name"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, label, ids, names = shared.value
        bounds, best = Bounds(q, *edges), Best(len(q), k)
        for code, x, own_label, own_id, own_name in _batches(batches, width):
            xe = bounds.edges(code)
            for one in np.intersect1d(label, own_label):
                rows = np.flatnonzero(own_label == one)
                mine = np.flatnonzero(label == one)
                for p in range(0, len(mine), SLICE):
                    asked = mine[p : p + SLICE]
                    low, high = bounds.between(asked, xe, rows)
                    itself = own_id[rows] == ids[asked][:, None]
                    low[itself], high[itself] = -np.inf, -np.inf
                    take = min(k, len(rows))
                    reach = np.partition(low, len(rows) - take, axis=1)[:, len(rows) - take] if take == k else np.full(len(asked), -np.inf)
                    a, r = np.nonzero((high >= np.maximum(reach, best.least[asked].astype(np.float64) - bounds.slack)[:, None]) & ~itself)
                    a, r = asked[a], rows[r]
                    s = _exact(q, x, a, r)
                    enters = s >= best.least[a]
                    best.add(a[enters], s[enters], own_id[r[enters]], own_name[r[enters]])
        g, s, i, n = best.held
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[g], names[g], i, n, s)], names=["anchor", "name", "id", "other", "score"])

    found = approximated.mapInArrow(run, "anchor long, name long, id long, other long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "name").orderBy(F.desc("score"), "id", "other"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def negatives(approximated: DataFrame, anchors: pa.Table, found: pa.Table, edges: tuple[np.ndarray, np.ndarray], k: int, least: int, most: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors and their positives.

    The window of a positive holds the scores from ``least`` to ``most`` hundredths of its own. A row
    of another label is scored only if its bounds meet a window at or above the k-th score held there.
    """
    width = len(edges[0])
    columns = [anchors.column(c).to_numpy() for c in ("label", "id", "name")]
    at = {key: n for n, key in enumerate(zip(columns[1].tolist(), columns[2].tolist(), strict=True))}
    owner = np.array([at[key] for key in zip(found.column("anchor").to_pylist(), found.column("name").to_pylist(), strict=True)], np.int64)
    order = np.argsort(owner, kind="stable")
    windows = owner[order], *(found.column(c).to_numpy()[order] for c in ("score", "id", "other"))
    shared = approximated.sparkSession.sparkContext.broadcast((matrix(anchors.column("v"), width), *columns, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, label, ids, names, (owner, score, positive, other) = shared.value
        floor, ceiling = -((-least * score) // 100), (most * score) // 100
        bounds, best = Bounds(q, *edges), Best(len(owner), k, floor)
        first, n_windows = np.searchsorted(owner, np.arange(len(q))), np.bincount(owner, minlength=len(q))
        highest = np.full(len(q), np.iinfo(np.int64).min)
        np.maximum.at(highest, owner, ceiling)
        for code, x, own_label, own_id, own_name in _batches(batches, width):
            xe = bounds.edges(code)
            for r0 in range(0, len(x), SLICE):
                for a0 in range(0, len(q), SLICE):
                    reach = np.full(len(q), np.iinfo(np.int64).max)
                    np.minimum.at(reach, owner, best.least)
                    asked, rows = slice(a0, a0 + SLICE), slice(r0, r0 + SLICE)
                    low, high = bounds.between(asked, xe, rows)
                    near = (high >= reach[asked].astype(np.float64)[:, None]) & (low <= highest[asked].astype(np.float64)[:, None])
                    a, r = np.nonzero(near & (label[asked][:, None] != own_label[rows]))
                    # one row for each window of the anchor; those that the bounds rule out go before anything is scored
                    times = n_windows[a + a0]
                    pair = np.repeat(np.arange(len(a)), times)
                    g = np.repeat(first[a + a0] - np.cumsum(times) + times, times) + np.arange(len(pair))
                    may = (high[a, r][pair] >= best.least[g]) & (low[a, r][pair] <= ceiling[g])
                    pair, g = pair[may], g[may]
                    scored, back = np.unique(pair, return_inverse=True)
                    s = _exact(q, x, a[scored] + a0, r[scored] + r0)[back]
                    enters = (s >= best.least[g]) & (s <= ceiling[g])
                    won = r[pair[enters]] + r0
                    best.add(g[enters], s[enters], own_id[won], own_name[won])
        g, s, i, n = best.held
        out = (ids[owner[g]], names[owner[g]], positive[g], other[g], score[g], i, n, s)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["anchor_id", "name", "positive_id", "other", "positive_score", "negative_id", "own", "negative_score"])

    near = approximated.mapInArrow(run, "anchor_id long, name long, positive_id long, other long, positive_score long, negative_id long, own long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "name", "positive_id", "other").orderBy(F.desc("negative_score"), "negative_id", "own"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0, cells: int = CELLS) -> DataFrame:
    """Hard negatives of the anchors among ``vectors`` (id, label, vector), for each of their positives.

    Components become floor(scale * x); a score is the inner product of whole numbers. Positives are
    an anchor's first ``n_positives`` other rows of its label, negatives the first ``n_negatives`` rows
    of other labels whose score is ``least`` to ``most`` hundredths of the positive's; higher scores
    first, ties by the smaller id.

    The approximations are written once beside the vectors. Anchors travel in blocks by hash; each
    block reads the rows twice, and a task keeps only the best of each anchor, so neither a key nor a
    label gathers in one task. Rows that repeat all three columns are one row; rows of one id that
    differ are rows of their own, never each other's positives. Nulls and non-finite components take
    no part, empty vectors score 0, shorter ones as if they ended in zeros; components beyond
    ``LARGEST`` count as it. No rows, no anchors or one label only: no rows out. Other columns are ignored.
    """
    rows = materialise(quantised(vectors, scale), "negatives-rows")
    anchor = is_anchor(F.col("id"))
    n_anchors = rows.where(anchor).count()
    parts = [rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")]
    if n_anchors:
        edges = cell_edges(rows, cells)
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        approximated = materialise(with_codes(rows.repartition(tasks, "name"), edges[0]), "negatives-cells")
        blocks = -(-n_anchors // ANCHORS_AT_ONCE)
        for block in range(blocks):
            some = rows.where(anchor & (F.pmod("name", F.lit(blocks)) == block)).toArrow()
            best = positives(approximated, some, edges, n_positives).toArrow()
            parts.append(materialise(negatives(approximated, some, best, edges, n_negatives, least, most), "negatives"))
    found = parts[-1]
    for p in parts[1:-1]:
        found = found.unionAll(p)
    return found
