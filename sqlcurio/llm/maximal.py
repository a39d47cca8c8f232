"""Maximal repeats of any length with all occurrences, from common-prefix interval trees.

A maximal repeat starts where its occurrences differ in the byte before. Only such starts are
followed: first, strings of ``least`` bytes that occur more than once behind differing bytes; then,
round by round, the bytes that come next, twice as many where all of a group agree. The next bytes
of a group, sorted, are an enhanced suffix array of its members; a stack scan gives its intervals.
An interval whose members differ to the left and end within the bytes read is a maximal repeat; one
that fills them goes on to the next round; one behind equal bytes belongs to its parent. So a passage
is read once from each of its starts, and what lies within it costs nothing after its anchors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcurio.llm.common import NULL_KEY, discard, materialise
from sqlcurio.llm.repeats import LEAST, anchors, interval_tree, with_key
from sqlcurio.llm.simhash import runs_of_keys

#: Bytes that a group is first read on for, and most that a task takes to its stack scan.
WIDTH, MOST_WIDTH = 256, 8192
#: A group with more bytes to read is split by Spark, a branching at a time, instead of within a task.
MOST_BYTES = 1 << 24
#: Starts that a task names before it hands them on.
AT_ONCE = 1 << 16
#: A start in a group, ``depth`` bytes of which agree, under the repeat (name, length, parent) found last.
#: Without a node the row is a result; without a start that of a group, else of an occurrence.
ROW = {"node": "string", "depth": "long", "name": "string", "length": "long", "parent": "string", "key": "long", "tie": "long", "start": "long", "left": "int", "width": "int"}
FIELDS = list(ROW)
SCHEMA = ", ".join(f"{c} {kind}" for c, kind in ROW.items())
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def name_of(key: int, tie: int, start: int, length: int) -> str:
    """A repeat's name: its first occurrence and its length."""
    return xxhash.xxh3_128_hexdigest(struct.pack("<4q", key, tie, start, length))


def common_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    return int(np.argmax(np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, k in zip(cols, ROW.values(), strict=True)], names=FIELDS)


def starts(texts: DataFrame, least: int) -> DataFrame:
    """Rows of the strings of ``least`` bytes in ``texts`` (key, tie, raw) that may begin a maximal repeat.

    Strings that share an anchor's context, and the byte before it, with all other occurrences of the
    anchor lie behind equal bytes everywhere. One minimum and maximum an anchor tells that, so only
    contexts at the edges of passages give their strings.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, tie, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = raw.as_py()
                h, first, count = anchors(raw, least)
                ends = (first + count + least - 1).tolist()
                names = [xxhash.xxh3_64_intdigest(raw[s - 1 : e] if s else struct.pack("<2q", key, tie)) for s, e in zip(first.tolist(), ends, strict=True)]
                cols = [h, np.array(names, np.uint64).view(np.int64), np.full(len(h), key), np.full(len(h), tie), first << 8 | count]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["grp", "context", "key", "tie", "spot"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for key, tie, raw, spots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = raw.as_py()
                for spot in spots:
                    for at in range(spot >> 8, (spot >> 8) + (spot & 255)):
                        rows.append((xxhash.xxh3_128_hexdigest(raw[at : at + least]), least, "", 0, "", key, tie, at, raw[at - 1] if at else -1, WIDTH))
                    if len(rows) >= AT_ONCE:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    found = texts.mapInArrow(find, "grp long, context long, key long, tie long, spot long")
    edges = found.groupBy("grp").agg(F.min("context").alias("lo"), F.max("context").alias("hi")).where("lo <> hi").select("grp")
    spots = found.join(edges, "grp").groupBy("key", "tie").agg(F.collect_list("spot").alias("spots"))
    return texts.join(spots, ["key", "tie"]).select("key", "tie", "raw", "spots").mapInArrow(cut, SCHEMA)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that follow from whole groups, each with the bytes it reads on for, sorted by node and these bytes."""
    for node, depth, name, length, parent, key, tie, start, left, width, ahead in runs_of_keys(batches):
        count, same = len(node), np.r_[False, node[1:] == node[:-1]]
        # one more than the common prefix, so that a group is one tree even where nothing is common
        lcp = [common_prefix(ahead[i - 1], ahead[i]) + 1 if same[i] else 0 for i in range(count)]
        rank = np.empty(count, np.int64)
        rank[np.lexsort((start, tie, key))] = np.arange(count)
        trees = interval_tree(lcp, rank.tolist(), np.where(left < 0, -2 - np.arange(count), left).tolist(), 1)
        above_of = {c: k for k, t in enumerate(trees) for c in t.children}
        own: list[tuple] = [()] * len(trees)
        rows: list[tuple] = []
        for k in range(len(trees) - 1, -1, -1):  # parents first
            t, i = trees[k], trees[k].best
            above = own[above_of[k]] if k in above_of else (name[i], int(length[i]), parent[i])
            total = int(depth[i]) + t.length - 1
            id_, reach, on = "", 0, 0
            if not t.maximal:
                own[k] = above
            elif t.length - 1 == width[i]:
                own[k], id_, reach, on = above, name_of(key[i], tie[i], start[i], total), total, 2 * int(width[i])
            else:
                own[k] = (name_of(key[i], tie[i], start[i], total), total, above[0])
                rows.append(("", 0, *own[k], 0, 0, -1, 0, 0))
            rows += [(id_, reach, *own[k], int(key[x]), int(tie[x]), int(start[x]), int(left[x]), on) for x in t.leaves]
        if rows:
            yield _batch(rows)


def branches(members: DataFrame) -> DataFrame:
    """As :func:`scan`, but a group is split where it first branches, by aggregates only.

    What its least and its greatest member have in common all have, so no task holds a group.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, depth, lo, hi, best in zip(*[c.to_pylist() for c in b.columns], strict=True):
                common = common_prefix(lo, hi)
                rows.append((node, common, name_of(best["key"], best["tie"], best["start"], depth + common)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.string()], strict=True)], names=["node", "common", "own"])

    best = F.min(F.struct("key", "tie", "start")).alias("best")
    ends = members.groupBy("node").agg(F.first("depth").alias("depth"), F.min("ahead").alias("lo"), F.max("ahead").alias("hi"), best)
    tops = materialise(ends.mapInArrow(top, "node string, common long, own string"), "maximal-tops")
    joined = members.join(tops, "node")
    onward, total = F.col("common") == F.col("width"), F.col("depth") + F.col("common")
    over = F.octet_length("ahead") == F.col("common")
    follower = F.hex(F.substring("ahead", F.col("common").cast("int") + 1, F.lit(1)))
    known = lambda c, new: F.when(onward, F.col(c)).otherwise(new).alias(c)
    moved = joined.select(
        known("node", F.when(over, "").otherwise(F.concat("own", follower))),
        F.when(onward, total).otherwise(total + 1).alias("depth"),
        known("name", F.col("own")), known("length", total), known("parent", F.col("name")),
        "key", "tie", "start", "left", F.when(onward, 2 * F.col("width")).otherwise(WIDTH).cast("int").alias("width"),
    )
    shape = members.groupBy("node").agg(*[F.first(c).alias(c) for c in ("depth", "name", "width")])
    nothing = [F.lit(n).cast(ROW[c]).alias(c) for c, n in (("key", 0), ("tie", 0), ("start", -1), ("left", 0), ("width", 0))]
    groups = shape.join(tops, "node").where(~onward).select(
        F.lit("").alias("node"), F.lit(0).cast("long").alias("depth"), F.col("own").alias("name"), total.alias("length"), F.col("name").alias("parent"), *nothing
    )
    return moved.unionAll(groups)


def deepen(live: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows after reading on from the starts ``live``; those that are alone or behind equal bytes end."""
    sizes = live.groupBy("node").agg(F.count("*").alias("n"), F.min("left").alias("lo"), F.max("left").alias("hi"))
    judged = live.join(sizes, "node")
    goes = F.expr("n > 1 AND (lo < hi OR lo < 0)")
    ended = judged.where(~goes & (F.col("name") != "")).select(F.lit("").alias("node"), *FIELDS[1:])
    ahead = F.substring("raw", (F.col("start") + F.col("depth") + 1).cast("int"), F.col("width")).alias("ahead")
    members = materialise(judged.where(goes).join(texts, ["key", "tie"]).select(*FIELDS, "n", ahead), "maximal-members")
    small = (F.col("width") <= MOST_WIDTH) & (F.col("n") * F.col("width") <= MOST_BYTES)
    scanned = members.where(small).select(*FIELDS, "ahead").repartition("node").sortWithinPartitions("node", "ahead", "key", "tie", "start").mapInArrow(scan, SCHEMA)
    out = materialise(ended.select(FIELDS).unionAll(scanned).unionAll(branches(members.where(~small)).select(FIELDS)), "maximal-round")
    discard(members)
    return out


def maximal_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Groups of maximal repeats of at least ``least`` bytes with all occurrences.

    Returns repeat (its name), parent, length, doc_id and start (in UTF-8 bytes). A group has one row
    with neither doc_id nor start, which names its parent: the next shorter group, which holds all its
    occurrences and more (null at the root of a tree). Each occurrence has one row, in the longest
    group it is in, so a group's occurrences are its own rows and those of its descendants. Repeats
    are maximal in whole documents: some two of their occurrences differ in the byte before or begin a
    document, and some two in the byte behind or end one. Matches never cross documents.

    Rounds grow with the logarithm of the longest repeat and, for groups over MOST_BYTES, with the
    number of branchings above their parts; a round shuffles the texts that hold a start. Groups of
    strings are told apart by 128-bit hashes at ``least`` bytes, byte by byte beyond.

    Null text counts as empty; texts under ``least`` bytes repeat nothing. Rows that repeat doc_id (or
    null) and text are one document; rows that share a doc_id but not the text are documents of their
    own, as are those without a doc_id. Very long texts are read in segments for anchors, whole by one
    task. No rows in, no rows out; other columns are ignored. A doc_id that is no whole number is refused.
    """
    texts = with_key(docs).where(F.octet_length("raw") >= least).dropDuplicates(["key", "tie"])
    live = materialise(starts(texts, least), "maximal-starts")
    held = materialise(texts.join(live.select("key", "tie").distinct(), ["key", "tie"], "left_semi").select("key", "tie", "raw"), "maximal-texts")
    found = live.where("node = ''")
    while not live.isEmpty():
        done = deepen(live, held)
        found, live = found.unionAll(done.where("node = ''")), done.where("node <> ''")
    kind = docs.schema["doc_id"].dataType.simpleString()
    occurrence = F.col("start") >= 0
    return found.select(
        F.col("name").alias("repeat"), F.when(F.col("parent") != "", F.col("parent")).alias("parent"), "length",
        F.when(occurrence & (F.col("key") != NULL_KEY), F.col("key")).cast(kind).alias("doc_id"), F.when(occurrence, F.col("start")).alias("start"),
    )
