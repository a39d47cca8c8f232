"""SimHash near-duplicates by deletion-variant signatures of three fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlcurio.llm.common import NULL_KEY, connected_components, document_key, materialise

#: Bits of each segment. Four differing bits over three segments leave one with at most one.
SEGMENTS = (21, 21, 22)
MOST_BITS = 4
SMALL_RUN = 8
#: Longer runs are parted by further bits before fingerprints are compared.
BIG_RUN = 1024


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: -width]]).tolist()
        slices = map(joined.__getitem__, map(slice, starts, (ends[width - 1 :] - 1).tolist()))
        hashes = list(map(xxhash.xxh64_intdigest, slices, repeat(seed)))
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(key, tie, fp) of every row; key and tie name its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter(map(fingerprint, (x.as_py() for x in b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps.view(np.int64))], names=["key", "tie", "fp"])

    return docs.select(*document_key(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, tie long, fp long")


def forest(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Edges (positions) that connect exactly what links of at most ``most_bits`` connect.

    Each row is compared once with the later rows that are not yet joined to it, so a dense group
    costs a few passes and gives fewer edges than rows.
    """
    label, edges, left = np.arange(len(fps)), [], len(fps)
    for p in range(len(fps) - 1):
        other = np.nonzero(label[p + 1 :] != label[p])[0] + p + 1
        near = other[np.bitwise_count(fps[other] ^ fps[p]) <= most_bits]
        if len(near):
            labels, first = np.unique(label[near], return_index=True)
            edges += [(p, int(q)) for q in near[first]]
            label[np.isin(label, labels)] = label[p]
            left -= len(labels)
            if left == 1:
                break
    return edges


def parted_forest(fps: np.ndarray, places: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """The same as :func:`forest` where many fingerprints share a variant but few are near one another.

    The bits ``places``, which hold all differences but one, are cut into one part more than bits may
    differ; linked fingerprints are equal in a part and meet in its run, which is parted again if it
    is still long. Runs that hardly shrink are dense groups, which :func:`forest` joins in few passes.
    """
    if len(fps) <= BIG_RUN or len(places) <= most_bits:
        return forest(fps, most_bits)
    edges: list[tuple[int, int]] = []
    for part in np.array_split(places, most_bits + 1):
        value = fps & np.bitwise_or.reduce(np.uint64(1) << part.astype(np.uint64))
        order = np.argsort(value, kind="stable")
        value = value[order]
        start = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(value)], strict=True):
            if e - s > 1:
                own = order[s:e]
                deeper = 2 * (e - s) <= len(fps)
                found = parted_forest(fps[own], np.setdiff1d(places, part), most_bits) if deeper else forest(fps[own], most_bits)
                edges += [(int(own[p]), int(own[q])) for p, q in found]
    return edges


def runs_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Column arrays cut so that no run of equal first-column keys spans two yields."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
        if cols[0][-1] == cols[0][0]:
            if held and held[0][0][0] != cols[0][0]:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append(cols)
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        held.append(tuple(c[:cut] for c in cols))
        yield tuple(map(np.concatenate, zip(*held, strict=True)))
        held = [tuple(c[cut:] for c in cols)]
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all within ``most_bits``.

    Each fingerprint gives one row per bit: its segment with that bit deleted. Fingerprints that
    share a variant meet in one run of the shuffled, sorted rows and are verified on all 64 bits.
    """
    if most_bits >= 2 * len(SEGMENTS):
        raise ValueError("too few segments for so many bits")
    starts = [sum(SEGMENTS[:k]) for k in range(len(SEGMENTS))]
    start = F.expr("CASE " + " ".join(f"WHEN bit < {s + w} THEN {s}" for s, w in zip(starts, SEGMENTS, strict=True)) + " END")
    mask = F.expr("CASE " + " ".join(f"WHEN bit < {s + w} THEN {(1 << w) - 1}L" for s, w in zip(starts, SEGMENTS, strict=True)) + " END")
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).withColumn("_s", start).withColumn("_m", mask)
    rows = rows.select(F.expr("shiftleft(cast(bit as bigint), 22) | (shiftrightunsigned(fp, _s) & _m & ~shiftleft(1L, bit - _s))").alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in runs_of_keys(batches):
            f = fp.view(np.uint64)
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            found = []
            small = np.repeat(size <= SMALL_RUN, size)
            for step in range(1, min(SMALL_RUN, int(size.max()))):
                at = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
                at = at[np.bitwise_count(f[at] ^ f[at + step]) <= most_bits]
                found.append(np.stack([fp[at], fp[at + step]]))
            for s, n in zip(start[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist(), strict=True):
                bit = int(key[s]) >> 22
                low, width = next((x, w) for x, w in zip(starts, SEGMENTS, strict=True) if bit < x + w)
                outside = np.setdiff1d(np.arange(64), np.arange(low, low + width))
                if edges := parted_forest(f[s : s + n], outside, most_bits):
                    e = np.array(edges).T + s
                    found.append(np.stack([fp[e[0]], fp[e[1]]]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def rooted(marked: DataFrame, most_bits: int) -> DataFrame:
    """(fp, rep, root): each fingerprint's first document, and the fingerprint that names its component."""
    nodes = materialise(marked.groupBy("fp").agg(F.min(F.struct("key", "tie")).alias("rep")), "simhash-nodes")
    parts = connected_components(links(nodes.select("fp"), most_bits), "simhash")
    return nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text).

    Equal fingerprints are one node from the start, so copies cost nothing further. component_id is
    the smallest doc_id reachable over links. Null, empty and wordless texts have fingerprint zero
    and link like any other. Repeated rows are kept. A very long text is hashed by one task, 65536
    shingles at a time. No rows in, no rows out; other columns are ignored. A null doc_id is kept
    and never names a component that has another; a doc_id that is no whole number is refused.
    """
    marked = materialise(with_fingerprints(docs), "simhash")
    all_rooted = rooted(marked, most_bits)
    least = all_rooted.groupBy("root").agg(F.min("rep.key").alias("_least"))
    named = all_rooted.join(least, "root").select("fp", "_least")
    known = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return marked.join(named, "fp").select(known("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("_least").alias("component_id"))


def keep_first(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row of each component: that of the first document by doc_id, null last, then by a hash of the text.

    Rows that repeat doc_id and text are one document, of which any one row stays. Null, empty and
    wordless texts are one component. The rest is as in :func:`near_duplicates`.
    """
    marked = materialise(with_fingerprints(docs), "simhash")
    first = rooted(marked, most_bits).groupBy("root").agg(F.min("rep").alias("rep")).select("rep.key", "rep.tie")
    whole = docs.select(*document_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # in the order of the join, so the number needs neither a shuffle nor a sort of its own
    number = F.row_number().over(Window.partitionBy("key", "tie").orderBy("key"))
    return whole.join(first, ["key", "tie"], "left_semi").withColumn("_number", number).where("_number = 1").select("_row.*")
