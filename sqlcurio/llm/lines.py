"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcurio.llm.common import connected_components, document_key, materialise
from sqlcurio.llm.simhash import runs_of_keys

#: Bytes of a character shingle.
SHINGLE = 8
JACCARD = 0.8
#: At similarity 0.8 a pair misses all bands with probability (1 - 0.8^5)^10, under 2 in 100.
BANDS, ROWS = 10, 5
AT_ONCE = 1 << 16
#: Lines of a bucket that meet in one task; a larger bucket is dealt into parts of about so many.
PART = 512
#: Lines of a larger bucket that every part of it sees.
PIVOTS = 16
#: So many rivals are compared one by one.
FEW = 8


def normal_lines(text: str | None) -> list[tuple[int, bytes]]:
    """Number and normal form (lower case, single blanks) of each line that has a word."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    return [(k, b" ".join(w)) for k, line in enumerate(raw.split(b"\n")) if (w := line.split())]


def shingles(line: bytes) -> np.ndarray:
    """The line's distinct shingles, each as the number its 8 bytes make, sorted. A shorter line is one shingle."""
    if len(line) < SHINGLE:
        return np.array([int.from_bytes(line, "little") | len(line) << 56], np.uint64)
    return np.unique(np.ndarray((len(line) - SHINGLE + 1,), "<u8", line, strides=(1,)))


def families(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32), rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(lines: list[bytes]) -> np.ndarray:
    """A row of band keys for each line."""
    flips, factors = families()
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, b"\x00") for x in lines]
    out = np.empty((len(lines), BANDS), np.uint64)
    lo = 0
    while lo < len(lines):
        hi, size = lo, 0
        while hi < len(lines) and (hi == lo or size + len(padded[hi]) <= AT_ONCE):
            size += len(padded[hi])
            hi += 1
        lengths = np.fromiter(map(len, padded[lo:hi]), np.int64, hi - lo)
        buffer = b"".join(padded[lo:hi])
        words = np.ndarray((len(buffer) - SHINGLE + 1,), "<u8", buffer, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        h = ((words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        begins = np.cumsum(lengths) - lengths
        # alternate segments: the shingles of a line, then those that straddle two lines
        cuts = np.stack([begins, begins + lengths - SHINGLE + 1], axis=1).ravel()[:-1]
        key = np.empty(hi - lo, np.uint64)
        for band in range(BANDS):
            key[:] = band + 1
            for k in range(band * ROWS, band * ROWS + ROWS):
                least = np.minimum.reduceat((h ^ flips[k]) * factors[k], cuts)[::2]
                key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            out[lo:hi, band] = key
        lo = hi
    return out


def similar_edges(lines: list[bytes], least: float = JACCARD, label: np.ndarray | None = None, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect exactly what pairs of Jaccard similarity ``least`` or more connect.

    Lines of one ``label`` count as joined from the start; ``ask`` names the places one of which is
    in each pair (else all). Pairs already joined are not compared again, so a dense bucket costs a
    few passes; a line meets all its rivals in one pass over the codes of their shingles.
    """
    sets = [shingles(x) for x in lines]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    edges, left, index = [], len(np.unique(label)), None
    for p in range(len(sets) - 1) if ask is None else ask.tolist():
        if left < 2:
            break
        fits = (label != label[p]) & (np.minimum(sizes, sizes[p]) >= least * np.maximum(sizes, sizes[p]))
        if ask is None:
            fits[:p] = False
        rivals = np.flatnonzero(fits)
        if rivals.size < FEW:
            both = np.fromiter((np.intersect1d(sets[p], sets[q], assume_unique=True).size for q in rivals.tolist()), np.int64, rivals.size)
        else:
            if index is None:
                codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
                index = codes, np.cumsum(sizes) - sizes, np.zeros(int(codes.max()) + 1, bool)
            codes, starts, mark = index
            own = codes[starts[p] : starts[p] + sizes[p]]
            mark[own] = True
            both = np.add.reduceat(mark[codes], starts, dtype=np.int64)[rivals]
            mark[own] = False
        for q in rivals[both >= least * (sizes[p] + sizes[rivals] - both)].tolist():
            if label[q] != label[p]:
                edges.append((p, q))
                label[label == label[q]] = label[p]
                left -= 1
    return edges


def line_rows(docs: DataFrame, with_text: bool) -> DataFrame:
    """(lid, key, tie, line[, text]) of lines with words; within a task only a line's first occurrence."""
    schema = "lid long, key long, tie long, line long" + ", text binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}  # first document so far: splits are bounded, and so is this
        for b in batches:
            rows = []
            for *doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                doc = tuple(doc)
                for number, line in normal_lines(text.as_py()):
                    lid = xxhash.xxh64_intdigest(line)
                    lid -= (lid >> 63) << 64
                    if lid not in seen or seen[lid] > doc:
                        seen[lid] = doc
                        rows.append((lid, *doc, number, line)[: 4 + with_text])
            if rows:
                cols = zip(*rows, strict=True)
                types = [*[pa.int64()] * 4, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=["lid", "key", "tie", "line", "text"][: 4 + with_text])

    return docs.select(*document_key(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def line_links(docs: DataFrame, least: float = JACCARD, part: int = PART) -> DataFrame:
    """Edges (a, b) between ids of distinct lines that connect what verified pairs of a bucket connect.

    A bucket of more than ``part`` lines is dealt into parts by a hash of the line. Each part is
    verified with PIVOTS lines of the bucket that all its parts see, so variants of one line come
    together without meeting. :func:`_across` then verifies what is left between parts.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["band", "lid"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, lid in runs_of_keys(batches):
            start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            size = np.diff(np.r_[start, len(band)])
            # buckets with the same members need one check: name them by their members
            mixed = lid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            whole = np.repeat(np.add.reduceat(mixed, start), size)
            parts = np.repeat(-(-size // part), size)
            home = ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)
            # the first lines of a large bucket are its pivots, a row for each part
            pivot = (np.arange(len(lid)) - np.repeat(start, size) < PIVOTS) & (parts > 1)
            times = np.where(pivot, parts, np.repeat(size > 1, size))
            at = np.repeat(np.arange(len(lid)), times)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            where = np.where(pivot[at], nth, home[at])
            large = parts[at] > 1
            bucket = np.where(large, whole[at] ^ (where + 1).astype(np.uint64) * np.uint64(0x94D049BB133111EB), whole[at])
            # a line counts as a member in its own part only; parts 0: visiting, or nothing left to do
            member = large & (where == home[at])
            cols = [bucket.view(np.int64), lid[at], whole[at].view(np.int64), where, np.where(member, parts[at], 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "lid", "whole", "part", "parts"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, lid, whole, place, parts, text in runs_of_keys(batches):
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[start[1:], len(bucket)]
            edges = [(lid[s + p], lid[s + q]) for s, e in zip(start.tolist(), ends.tolist(), strict=True) for p, q in similar_edges(text[s:e].tolist(), least)]
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, **dict.fromkeys(("whole", "part", "parts", "text"), [None] * len(a))}, schema=out)
            of = parts > 0
            if of.any():
                yield pa.RecordBatch.from_pydict({"a": lid[of], "b": [None] * int(of.sum()), "whole": whole[of], "part": place[of], "parts": parts[of], "text": text[of]}, schema=out)

    out = pa.schema([*[(c, pa.int64()) for c in ("a", "b", "whole", "part", "parts")], ("text", pa.binary())])
    # one exchange of lines by id serves the bands and, as the join needs no other, the check
    # (the join would filter nulls on its side only, and then not share)
    lines = line_rows(docs, True).where("lid is not null").groupBy("lid").agg(F.first("text").alias("text"))
    rows = lines.mapInArrow(bands, "band long, lid long")
    found = rows.repartition("band").sortWithinPartitions("band", "lid").mapInArrow(buckets, "bucket long, lid long, whole long, part long, parts long").distinct()
    texts = found.join(lines, "lid").select("bucket", "lid", "whole", "part", "parts", "text")
    checked = texts.repartition("bucket").sortWithinPartitions("bucket", "lid").mapInArrow(verify, "a long, b long, whole long, part long, parts long, text binary")
    checked = materialise(checked, "lines-checked")
    edges, members = checked.where("b is not null").select("a", "b"), checked.where("b is null").drop("b").withColumnRenamed("a", "lid")
    return edges if members.isEmpty() else _across(edges, members, least, part)


def _across(edges: DataFrame, members: DataFrame, least: float, part: int) -> DataFrame:
    """``edges`` as stars, and what is similar between parts of large buckets.

    ``members`` are (lid, whole, part, parts, text). All members of a bucket's largest component are
    joined already. The others, its loose lines, are cut into blocks, and each block meets each part
    of the bucket in a task of its own. No pair of different components is left out.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, root, loose, text in runs_of_keys(batches):
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
                pairs = similar_edges(text[s:e].tolist(), least, root[s:e], np.flatnonzero(loose[s:e]))
                if pairs:
                    p, q = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([pa.array(root[s + p]), pa.array(root[s + q])], names=["a", "b"])

    roots = materialise(connected_components(edges, "lines-parts"), "lines-parts-roots")
    rooted = members.join(roots.withColumnRenamed("node", "lid"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    counts = rooted.groupBy("whole", "parts", "root").agg(F.count("*").alias("n"))
    left = counts.groupBy("whole", "parts").agg(F.max_by("root", F.struct("n", "root")).alias("most"), (F.sum("n") - F.max("n")).alias("loose")).where("loose > 0")
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = left.select("whole", "most", F.ceil(F.col("loose") / part).alias("blocks"), F.explode(up_to("parts")).alias("part"))
    open_ = rooted.join(left, ["whole", "part"])
    block = F.pmod(F.xxhash64("lid"), "blocks").alias("block")
    asks = open_.where("root <> most").select("whole", F.explode(up_to("parts")).alias("part"), block, "lid", "root", F.lit(True).alias("loose"), "text")
    told = open_.select("whole", "part", F.explode(up_to("blocks")).alias("block"), "lid", "root", F.lit(False).alias("loose"), "text")
    meet = asks.unionAll(told).select(F.xxhash64("whole", "part", "block").alias("key"), "lid", "root", "loose", "text")
    more = meet.repartition("key").sortWithinPartitions("key", "lid", "loose").mapInArrow(verify, "a long, b long")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)


def _kept(docs: DataFrame, least: float) -> DataFrame:
    """(key, tie, kept_lines) of each document that keeps a line."""
    first = line_rows(docs, False).groupBy("lid").agg(F.min(F.struct("key", "tie", "line")).alias("at"))
    first = materialise(first, "lines-first")
    roots = connected_components(line_links(docs, least), "lines").withColumnRenamed("node", "lid")
    rooted = first.join(roots, "lid", "left").select(F.coalesce("root", "lid").alias("root"), "at")
    kept = rooted.groupBy("root").agg(F.min("at").alias("at")).select("at.*")
    return kept.groupBy("key", "tie").agg(F.array_sort(F.collect_list("line")).alias("kept_lines"))


def kept_lines(docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """doc_id, n_lines, n_kept and kept_lines (numbers from 0) of each row of ``docs`` (doc_id, text).

    Lines with a word are compared in lower case with single blanks. Lines whose sets of
    SHINGLE-byte shingles are similar (Jaccard ``least`` or more) are linked; of each component the
    first line by document and place stays. Exact copies are one line from the start: each task gives
    a line once, so a line in a third of all documents is no hot key. Lines are named by 64-bit
    hashes (equal hashes of different lines, about n^2 / 2^65, would merge two components).

    Null text, or text without a word, has no lines. Lines without words aren't counted, and
    :func:`drop_lines` leaves them. Rows that repeat doc_id (or null) and text are one document and
    share its kept lines; rows that share a doc_id but not the text are documents of their own, in
    the order of a hash of the text, and those without a doc_id come last. A very long text is read
    by one task, its lines one by one. No rows in, no rows out; other columns are ignored. A doc_id
    that is no whole number is refused.
    """
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    count = F.size(F.filter(F.split("text", "\n", -1), has_word))
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    slim = text.select("doc_id", *document_key(text), F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"))
    none = F.array().cast("array<bigint>")
    return slim.join(_kept(docs, least), ["key", "tie"], "left").select("doc_id", "n_lines", F.coalesce(F.size("kept_lines"), F.lit(0)).cast("long").alias("n_kept"), F.coalesce("kept_lines", none).alias("kept_lines"))


def drop_lines(docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``; the other columns stay."""
    whole = docs.select(*document_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs")).join(_kept(docs, least), ["key", "tie"], "left")
    stays = lambda line, k: ~line.rlike(r"[^\x20\x09-\x0D]") | F.coalesce(F.array_contains("kept_lines", k.cast("long")), F.lit(False))
    own = F.col("_docs.text")
    text = F.when(own.isNotNull(), F.array_join(F.filter(F.split(own, "\n", -1), stays), "\n"))
    return whole.select(*[text.alias("text") if c == "text" else F.col(f"_docs.`{c}`") for c in docs.columns])
