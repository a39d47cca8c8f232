"""Exact repeated passages by common-prefix interval trees of enhanced suffix arrays.

Suffixes are not sorted over the whole corpus. Every string of ``least`` bytes picks one of its
k-grams, the one of smallest hash, so equal strings pick equal k-grams; these anchors, about one
in thirty-five bytes, are shuffled by hash and those that occur once drop out. What is left
ships its context, the strings that picked it, to one place, and there an enhanced suffix array of
the contexts is scanned with a stack. Its intervals of at least ``least`` common bytes whose
members differ in the byte to their left say which bytes repeat (within a context; contexts of a
longer repeat follow one another). :mod:`sqlcurio.llm.maximal` lists whole maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcurio.llm.common import NULL_KEY, document_key, materialise
from sqlcurio.llm.simhash import runs_of_keys

LEAST = 100
GRAM = 32
SEGMENT = 1 << 23
MIX = np.uint64(0x9E3779B97F4A7C15)
DIVERSE = -1
WINDOWS_AT_ONCE = 150_000
#: Contexts that a task remembers; beyond, it forgets them and leaves their copies to the shuffle.
MOST_SEEN = 1_000_000
#: An anchor with more rows is hot: its strings are dealt by their own hashes instead of meeting in one task.
HOT_ROWS = 2000
HOT = 1
#: Parts in which the copies of one text meet the first of them.
SALTS = 16


def words_at(raw: bytes, extra: int = 0) -> np.ndarray:
    """The 8 bytes from each position on as one number."""
    return np.ndarray((len(raw) - 7 - extra,), "<u8", raw, strides=(1,))


def anchors(raw: bytes, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first string start and number of strings of each anchor, strings in order."""
    width, low = least - gram + 1, np.uint64((1 << 24) - 1)
    out = []
    for base in range(0, max(0, len(raw) - least + 1), SEGMENT):
        part = raw[base : base + SEGMENT + least - 1]
        n = len(part) - gram + 1
        words = words_at(part)
        h = np.zeros(n, np.uint64)
        for k in range(0, gram, 8):
            h = (h ^ words[k : k + n]) * MIX
            h ^= h >> np.uint64(29)
        value = (h & ~low) | np.arange(n, dtype=np.uint64)
        padded = np.concatenate([value, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out.append((h[at[first]].view(np.int64), first + base, np.diff(np.r_[first, len(at)])))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class Interval(NamedTuple):
    length: int
    maximal: bool  # members differ to the left
    leaves: list[int]  # members of this interval and of none of its children
    children: list[int]
    best: int  # the earliest member
    later: list[int]  # members that first meet an earlier one here


def interval_tree(lcp: list[int], rank: list[int], left: list[int], least: int) -> list[Interval]:
    """Intervals of common prefix >= ``least``, children before parents, from one stack scan.

    ``lcp[i]`` belongs to suffixes i - 1 and i. ``left`` is the byte before a suffix, or a number
    below DIVERSE that no other suffix has.
    """
    closed: list[Interval] = []
    stack: list[list] = []  # length, left, leaves, children, best, later

    def take(top: list, best: int, before: int) -> None:
        if top[4] is None:
            top[1], top[4] = before, best
            return
        if top[1] != before:
            top[1] = DIVERSE
        first, second = (best, top[4]) if rank[best] < rank[top[4]] else (top[4], best)
        top[4] = first
        if rank[second] > rank[first]:
            top[5].append(second)

    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        best, before, own = i - 1, left[i - 1], None
        while stack and stack[-1][0] > now:
            top = stack.pop()
            take(top, best, before)
            (top[2] if own is None else top[3]).append(best if own is None else own)
            closed.append(Interval(top[0], top[1] == DIVERSE, *top[2:]))
            best, before, own = top[4], top[1], len(closed) - 1
        if now >= least:
            if not stack or stack[-1][0] < now:
                stack.append([now, 0, [], [], None, []])
            take(stack[-1], best, before)
            (stack[-1][2] if own is None else stack[-1][3]).append(best if own is None else own)
    return closed


class Suffixes(NamedTuple):
    owner: np.ndarray  # context of each suffix, in suffix-array order
    offset: np.ndarray
    intervals: list[Interval]


def suffix_trees(contexts: list[bytes], group: np.ndarray, doc: np.ndarray, start: np.ndarray, least: int = LEAST) -> Suffixes:
    """Interval trees over the strings of ``contexts`` that occur more than once in their group.

    Strings are told apart by a hash of their first ``least`` bytes before sorting, so strings that
    occur once cost no sorting; the common prefixes themselves are compared byte by byte.
    """
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begins = np.cumsum(lengths) - lengths
    buffer = b"".join(contexts) + bytes(2 * int(lengths.max()) + 8)
    windows = lengths - least + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[owner] + offset
    words = words_at(buffer)
    h = group[owner].astype(np.uint64)
    for k in [*range(0, least - 7, 8), least - 8]:
        h = (h ^ words[at + k]) * MIX
        h ^= h >> np.uint64(31)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(counts[inverse] > 1)
    if not len(keep):
        return Suffixes(owner[:0], offset[:0], [])
    owner, offset, at, h = owner[keep], offset[keep], at[keep], h[keep]
    size, widest = lengths[owner] - offset, int(lengths.max())
    text = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buffer, np.uint8), widest)[at]
    text[np.arange(widest) >= size[:, None]] = 0
    tail = np.zeros((len(at), -(-(widest - least + 1) // 8) * 8), np.uint8)
    tail[:, : widest - least] = text[:, least:]
    columns = tail.view(">u8")
    order = np.lexsort((size, *[columns[:, k] for k in range(columns.shape[1] - 1, -1, -1)], h))
    owner, offset, size, text, h = owner[order], offset[order], size[order], text[order], h[order]
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), widest)
    lcp = np.concatenate([[0], np.minimum(np.minimum(common, size[1:]), size[:-1])])
    lcp[1:][group[owner[1:]] != group[owner[:-1]]] = 0
    place = np.lexsort((start[owner] + offset, doc[owner]))
    rank = np.empty(len(owner), np.int64)
    sorted_doc, sorted_at = doc[owner][place], (start[owner] + offset)[place]
    rank[place] = np.concatenate([[0], np.cumsum((sorted_doc[1:] != sorted_doc[:-1]) | (sorted_at[1:] != sorted_at[:-1]))])
    left = np.where(offset > 0, np.frombuffer(buffer, np.uint8)[begins[owner] + offset - 1].astype(np.int64), -2 - np.arange(len(owner)))
    return Suffixes(owner, offset, interval_tree(lcp.tolist(), rank.tolist(), left.tolist(), least))


def batches_of_groups(group: np.ndarray, windows: np.ndarray) -> Iterator[slice]:
    """Slices of whole groups with about WINDOWS_AT_ONCE strings."""
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
    total = np.cumsum(windows)
    at = 0
    while at < len(group):
        goal = (total[at - 1] if at else 0) + WINDOWS_AT_ONCE
        k = np.searchsorted(ends, at, "right")
        j = max(k, np.searchsorted(total[ends - 1], goal, "right") - 1)
        yield slice(at, int(ends[j]))
        at = int(ends[j])


def documents_of(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """A number for each (key, tie), in their order."""
    order = np.lexsort((tie, key))
    k, t = key[order], tie[order]
    number = np.empty(len(key), np.int64)
    number[order] = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (t[1:] != t[:-1]))])
    return number


def resolve(chunks: Iterator[tuple[np.ndarray, ...]], least: int = LEAST) -> Iterator[tuple[np.ndarray, ...]]:
    """Removable spans (key, tie, start, end) from context rows (group, context, key, tie, start, end), sorted by all.

    Rows without a context are spans that a task has found before; they pass. Strings of hot anchors
    come by name, 64 bits in the group and 64 for a context; equal names are equal strings.
    """
    for group, context, key, tie, start, end in chunks:
        known = context == b""
        if known.any():
            yield key[known], tie[known], start[known], end[known]
            group, context, key, tie, start, end = (x[~known] for x in (group, context, key, tie, start, end))
            if not len(group):
                continue
        doc = documents_of(key, tie)
        same = (group[1:] == group[:-1]) & (context[1:] == context[:-1]).astype(bool)
        first = np.flatnonzero(np.r_[True, ~same])
        of = np.cumsum(np.r_[True, ~same]) - 1
        later = np.flatnonzero((doc != doc[first[of]]) | (start != start[first[of]]))
        if len(later):
            yield key[later], tie[later], start[later], end[later]
        first = first[end[first] - start[first] == np.fromiter(map(len, context[first]), np.int64, len(first))]  # names of strings have no trees
        _, inverse, counts = np.unique(group[first], return_inverse=True, return_counts=True)
        reps = first[counts[inverse] > 1]
        if not len(reps):
            continue
        windows = np.fromiter(map(len, context[reps]), np.int64, len(reps)) - least + 1
        _, numbers = np.unique(group[reps], return_inverse=True)
        for part in batches_of_groups(numbers, windows):
            rows = reps[part]
            trees = suffix_trees(context[rows].tolist(), numbers[part], doc[rows], start[rows], least)
            found = [(x, t.length) for t in trees.intervals if t.maximal for x in t.later]
            if found:
                x, length = np.array(found).T
                own = rows[trees.owner[x]]
                begin = start[own] + trees.offset[x]
                order = np.lexsort((begin, own))
                own, begin, end = own[order], begin[order], (begin + length)[order]
                reach = np.maximum.accumulate(end + (own.astype(np.int64) << 40)) - (own.astype(np.int64) << 40)
                cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (begin[1:] > reach[:-1])])
                yield key[own[cut]], tie[own[cut]], begin[cut], reach[np.r_[cut[1:] - 1, len(own) - 1]]


def with_key(docs: DataFrame) -> DataFrame:
    """(key, tie, raw) of every document."""
    return docs.select(*document_key(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))


def copies(texts: DataFrame, least: int) -> DataFrame:
    """(key, tie) of documents of at least ``least`` bytes whose whole text an earlier document has."""
    slim = materialise(texts.where(F.octet_length("raw") >= least).select("key", "tie", F.md5("raw").alias("digest")), "repeats-digests")
    first = slim.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first")
    # the copies of one text may be a third of all rows: each of SALTS parts of them meets the first on its own
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("key", "tie"), F.lit(SALTS)).cast("int"))
    return materialise(salted.join(first, ["digest", "salt"]).where("key > first").select("key", "tie").distinct(), "repeats-copies")


def sized_runs(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """Column arrays with the length of each row's run of equal first-column keys, or ``enough`` if it is as long.

    Of a run no more than ``enough`` rows are held.
    """
    held: tuple[np.ndarray, ...] | None = None
    long_key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
        if held is not None:
            cols = tuple(map(np.concatenate, zip(held, cols, strict=True)))
        key = cols[0]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.minimum(np.diff(np.r_[start, len(key)]), enough)
        if long_key is not None and key[0] == long_key:
            size[0] = enough
        cut = len(key)
        if size[-1] == enough:
            long_key = key[-1]
        else:
            cut = int(start[-1])
        sizes = np.repeat(size, np.diff(np.r_[start, len(key)]))
        held = tuple(c[cut:] for c in cols) if cut < len(key) else None
        if cut:
            yield tuple(c[:cut] for c in cols), sizes[:cut]
    if held is not None:
        yield held, np.full(len(held[0]), len(held[0]))


def contexts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(grp, ctx, key, tie, start, end): contexts of the anchors that occur more than once in ``texts`` (key, tie, raw).

    The texts come sorted by key within a partition, so a context that a task has met before is a
    repeat of an earlier one: it goes on as a span, with its end below 0 for a sign, and only the
    first of each task is shuffled as an anchor. That keeps a passage in a third of all texts to a
    row a task. What is left of an anchor in very many texts is the strings about it that differ, as
    at the edges of such a passage: those of a hot anchor are dealt by their own names, a hash of 128
    bits, so that no task or group holds them all.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last = None
        for b in batches:
            for key, tie, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = raw.as_py()
                h, first, count = anchors(raw, least)
                if not len(h) or last == (key, raw):
                    continue
                last = (key, raw)
                ends = (first + count + least - 1).tolist()
                names = [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(first.tolist(), ends, strict=True)]
                new = np.empty(len(names), bool)
                for k, name in enumerate(names):
                    size = len(seen)
                    seen.add(name)
                    new[k] = len(seen) > size
                if len(seen) > MOST_SEEN:
                    seen.clear()
                old = np.flatnonzero(~new)
                if len(old):  # old contexts that follow one another overlap and are one span
                    cut = np.flatnonzero(np.r_[True, old[1:] != old[:-1] + 1])
                    begin, end = first[old[cut]], np.array(ends)[old[np.r_[cut[1:] - 1, len(old) - 1]]]
                    spread = (np.full(len(cut), key, np.int64) + tie) * MIX.astype(np.int64)  # spans need no company: deal them by document
                    grp, loc, stop = np.r_[h[new], spread], np.r_[first[new] << 8 | count[new], begin], np.r_[np.zeros(new.sum(), np.int64), -end]
                else:
                    grp, loc, stop = h, first << 8 | count, np.zeros(len(h), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(np.full(len(grp), key)), pa.array(np.full(len(grp), tie)), pa.array(loc), pa.array(stop.astype(np.int32))], names=fields)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size in sized_runs(batches, HOT_ROWS + 1):
            anchor = rows[-1] == 0
            keep = (size > 1) | ~anchor
            rows = (*rows[:-1], np.where(anchor & (size > HOT_ROWS), np.int32(HOT), rows[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], names=fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of: dict[bytes, tuple[int, int, int]] = {}  # strings of hot anchors that this task has met
        for b in batches:
            for key, tie, raw, spots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw, (grp, loc, stop) = raw.as_py(), (spots.values.field(c).to_numpy() for c in ("grp", "loc", "stop"))
                rows = []
                for g, where, sign in zip(grp.tolist(), loc.tolist(), stop.tolist(), strict=True):
                    if sign < 0:
                        rows.append((g, b"", where, -sign))
                    elif sign != HOT:
                        first, end = where >> 8, (where >> 8) + (where & 255) + least - 1
                        rows.append((g, raw[first:end], first, end))
                    else:
                        met = None  # where a run of strings begins that this task knows an earlier place of
                        for at in range(where >> 8, (where >> 8) + (where & 255)):
                            name = xxhash.xxh3_128_digest(raw[at : at + least])
                            if first_of.get(name, (key, tie, at)) < (key, tie, at):
                                met = at if met is None else met
                                continue
                            if met is not None:
                                rows.append((g ^ key ^ tie, b"", met, at - 1 + least))
                                met = None
                            first_of[name] = (key, tie, at)
                            rows.append((int.from_bytes(name[:8], "little", signed=True), name[8:], at, at + least))
                        if met is not None:
                            rows.append((g ^ key ^ tie, b"", met, (where >> 8) + (where & 255) - 1 + least))
                if len(first_of) > MOST_SEEN:
                    first_of.clear()
                grp, cuts, start, end = zip(*rows, strict=True)
                cols = [pa.array(grp, pa.int64()), pa.array(cuts, pa.binary()), pa.array(np.full(len(rows), key)), pa.array(np.full(len(rows), tie)), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["grp", "ctx", "key", "tie", "start", "end"])

    fields, schema = ["grp", "key", "tie", "loc", "stop"], "grp long, key long, tie long, loc long, stop int"
    found = texts.select("key", "tie", "raw").sortWithinPartitions("key", "tie", "raw").mapInArrow(find, schema)
    often = found.repartition("grp").sortWithinPartitions("grp").mapInArrow(repeated, schema)
    spots = often.groupBy("key", "tie").agg(F.collect_list(F.struct("grp", "loc", "stop")).alias("spots"))
    return texts.join(spots.hint("shuffle_hash"), ["key", "tie"]).select("key", "tie", "raw", "spots").mapInArrow(cut, "grp long, ctx binary, key long, tie long, start long, end long")


def spans(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, tie, start, end) to remove, from context rows; they may overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in resolve(runs_of_keys(batches), least):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "tie", "start", "end"])

    return rows.repartition("grp").sortWithinPartitions("grp", "ctx", "key", "tie", "start").mapInArrow(run, "key long, tie long, start long, end long")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without the bytes of strings that started earlier.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept, the
    remaining bytes. A byte goes if a string of ``least`` bytes over it also starts earlier: in a
    smaller doc_id, or before in the same document. Whole copies of an earlier document go at once.
    The texts are shuffled by doc_id once; the three readings share that exchange.

    Null text counts as empty. Texts under ``least`` bytes stay whole. Rows that repeat doc_id (or
    null) and text are one document, given back as often as they came. Rows that share a doc_id but
    not the text are documents of their own, in the order of a hash of the text; so are those
    without a doc_id, which come last. Very long texts are read in segments. No rows in, no rows
    out; other columns are ignored. A doc_id that is no whole number is refused; 2^63 - 1 stands for null.
    """
    texts, own = with_key(docs), ["key", "tie"]
    gone = copies(texts, least).select(*own, F.lit(True).alias("copy"))
    # the same columns and no repartition() of its own each time, or the exchange isn't shared
    live = texts.join(gone.hint("shuffle_hash"), own, "left_anti").select("key", "tie", "raw")
    found = spans(contexts(live, least), least).groupBy(*own).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, is_copy, got in zip(b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                raw = raw.as_py()
                if is_copy:
                    runs = [(0, len(raw))]
                elif got.is_valid:
                    start, end = got.values.field("start").to_numpy(), np.minimum(got.values.field("end").to_numpy(), len(raw))
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    cut = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                    runs = list(zip(start[cut].tolist(), reach[np.r_[cut[1:] - 1, len(start) - 1]].tolist(), strict=True))
                else:
                    runs = []
                edges = [0, *[x for r in runs for x in r], len(raw)]
                kept = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = zip(*out, strict=True) if out else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = texts.join(gone.hint("shuffle_hash"), own, "left").join(found.hint("shuffle_hash"), own, "left").select("key", "raw", "copy", "spans")
    back = F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")).cast(kind)
    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumn("doc_id", back)
