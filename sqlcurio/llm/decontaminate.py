"""Benchmark passages in documents: CGK embedding, bit-sampling LSH over windows, exact edit check.

The CGK walk reads a string at a cursor that moves on, or not, by a random bit that depends on the
step and the byte read. Strings at small edit distance give outputs at small Hamming distance, as
the walks fall back into step after an edit; so sampled output positions collide as in any
bit-sampling LSH. Windows start at every character, in items and documents, blanks aside; an item is
looked at where enough of its windows collide about one place, however long it is or spaced.

Walks as long as an item don't serve: at the bound of 20 % of edits those of the worst tenth of
items agree in about one step of six, so millions of tables would be needed (see the README).
Items too short for windows are found by the parts that edits must leave whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sqlcurio.llm.common import document_key, materialise

#: Steps of a walk by least characters of an item; a walk of s steps reads about s / 2. The windows of an
#: item start at each of its characters but blanks, so the longer an item the longer the walks that some of them survive.
CLASSES = ((80, 20), (40, 12), (20, 10), (12, 8), (0, 4))
SAMPLED = 8  # positions of a walk, if it has so many: what it reads there is the key
#: An item is looked at where so large a share of the collisions comes together that edits are expected to leave.
FEW = 0.5
SIMILARITY = 0.8
WINDOWS_AT_ONCE = 1 << 16
HITS_AT_ONCE = 1 << 20
PIECES_AT_ONCE = 1 << 13
#: Items travel in blocks whose index stays below this; it takes at most about so many bytes a character.
INDEX_BYTES, INDEX_BYTES_PER_CHAR = 1 << 26, 160
LEAST_BYTES = 12  # shorter items have no windows
PIECE = 64  # characters of an item that are compared at once


def normal(text: str | None) -> bytes:
    """Lower case, words parted by single blanks."""
    return b" ".join((text or "").replace("\x00", " ").lower().encode("utf-8", "surrogatepass").split())


def folded(text: str) -> np.ndarray:
    """A byte for each character; unequal ones beyond ASCII may share it."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, codes, 128 | codes ^ codes >> 7).astype(np.uint8)


def walk(buffer: np.ndarray, at: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """CGK outputs, a row per step, of the windows that start at ``at``."""
    cursor, out = at.copy(), np.empty((len(moves), len(at)), np.uint8)
    for step, move in enumerate(moves):
        np.take(buffer, cursor, out=out[step], mode="clip")
        cursor += move.take(out[step])
    return out


class Table(NamedTuple):
    positions: np.ndarray
    first: np.ndarray  # where the windows of each hash begin, and end before the next
    owner: np.ndarray  # item of each window
    offset: np.ndarray


class Index(NamedTuple):
    item_ids: list
    texts: list[str]
    moves: np.ndarray  # step, byte -> 0 or 1
    tables: list[Table]
    lengths: np.ndarray
    slack: np.ndarray  # characters that edits may move the parts of an item by
    width: np.ndarray  # of the cells that collisions are counted in
    least: np.ndarray  # collisions without which an item is not looked at
    first_piece: np.ndarray  # of each item, and behind the last
    piece_at: np.ndarray
    piece_size: np.ndarray
    masks: np.ndarray  # piece, byte -> its places in the piece
    short: list[tuple[int, str]]  # items without windows, numbered behind the others
    parts: ahocorasick.Automaton | None  # (short item, offset, size) by the parts of the short items


def slack_of(length: np.ndarray | int, similarity: float) -> np.ndarray:
    return np.int64((1 - similarity) * np.asarray(length) + 1e-9) + 8


def build_index(items: list[tuple[object, str | None]], similarity: float = SIMILARITY, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    moves = rng.integers(0, 2, (CLASSES[0][1], 256)).astype(np.int32)
    every = [(i, normal(t)) for i, t in items]
    kept = [(i, t.decode("utf-8", "ignore")) for i, t in every if len(t) >= LEAST_BYTES]
    brief = [(i, t.decode("utf-8", "ignore")) for i, t in every if 0 < len(t) < LEAST_BYTES]
    lengths = np.array([len(t) for _, t in kept], np.int64)
    slack, least = slack_of(lengths, similarity), np.ones(len(kept), np.int64)
    width = 7 + slack // 8
    buffer = folded("".join(t + "\x00" for _, t in kept) + "\x00" * CLASSES[0][1])
    begins = np.cumsum(lengths + 1) - lengths - 1
    pieces = -(-lengths // PIECE)
    first_piece = np.concatenate([[0], np.cumsum(pieces)])
    of = np.repeat(np.arange(len(kept)), pieces)
    turn = np.arange(len(of)) - first_piece[of]
    piece_at = turn * lengths[of] // pieces[of]
    piece_size = (turn + 1) * lengths[of] // pieces[of] - piece_at
    masks = np.zeros((len(of), 256), np.uint64)
    for k in range(PIECE):
        some = np.flatnonzero(k < piece_size)
        masks[some, buffer[begins[of[some]] + piece_at[some] + k]] |= np.uint64(1 << k)
    tables, above = [], np.inf
    for shortest, steps in CLASSES:
        positions = np.sort(rng.choice(steps, min(steps, SAMPLED), replace=False))
        own = np.flatnonzero((lengths >= shortest) & (lengths < above))
        above = shortest
        if not len(own):
            continue
        owner = np.repeat(own, lengths[own])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(lengths[own]) - lengths[own], lengths[own])
        at = begins[owner] + offset
        full = buffer[at] > 32
        owner, offset, at = owner[full], offset[full], at[full]
        least[own] = np.maximum(1, FEW * np.bincount(owner, minlength=len(kept))[own] * similarity ** ((steps + 1) / 2))
        # equal windows of an item that lie close together are one, or periodic texts would meet in squares
        name = pack(walk(buffer, at.astype(np.int32), moves[:steps]), positions)
        bits = max(12, int(len(name)).bit_length() + 4)
        name = small_hash(name, bits)
        rows = np.unique(np.stack([name, owner, offset // (width[owner] // 4)]), axis=1, return_index=True)[1]
        name, owner, offset = name[rows], owner[rows], offset[rows]
        first = np.concatenate([[0], np.cumsum(np.bincount(name, minlength=1 << bits))]).astype(np.int32)
        tables.append(Table(positions, first, owner, offset))
    short = [(len(kept) + k, t) for k, (_, t) in enumerate(brief) if t]
    return Index([i for i, _ in kept + brief], [t for _, t in kept], moves, tables, lengths, slack, width, least, first_piece, piece_at, piece_size, masks, short, automaton(short, similarity))


def automaton(short: list[tuple[int, str]], similarity: float) -> ahocorasick.Automaton | None:
    """Each item in one part more than it may have edits: an item that is near has a part that is left whole."""
    parts: dict[str, list[tuple[int, int]]] = {}
    for place, (_, text) in enumerate(short):
        n = int((1 - similarity) * len(text) + 1e-9) + 1
        cuts = [k * len(text) // n for k in range(n + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            parts.setdefault(text[a:b], []).append((place, a))
    if not parts:
        return None
    found = ahocorasick.Automaton()
    for part, places in parts.items():
        found.add_word(part, (len(part), places))
    found.make_automaton()
    return found


def short_matches(norms: list[str], index: Index, similarity: float) -> list[tuple[int, int, int, int]]:
    """The items without windows in each text, exactly; a place beside an exact match is not looked at again."""
    out = []
    for x, text in enumerate(norms if index.parts else []):
        best: dict[int, int] = {}
        for last, (size, places) in index.parts.iter(text):
            for place, offset in places:
                if best.get(place) == 0:
                    continue
                pattern = index.short[place][1]
                most, start = int((1 - similarity) * len(pattern) + 1e-9), last + 1 - size - offset
                distance, _ = best_edit(pattern, text[max(0, start - most) : start + len(pattern) + most])
                if distance <= min(most, best.get(place, most)):
                    best[place] = distance
        out += [(x, index.short[place][0], d, len(index.short[place][1])) for place, d in best.items()]
    return out


def pack(outputs: np.ndarray, positions: np.ndarray) -> np.ndarray:
    keys = np.zeros((outputs.shape[1], SAMPLED), np.uint8)
    keys[:, : len(positions)] = outputs[positions].T
    return keys.view(np.uint64).ravel()


def small_hash(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def crowded(cells: Iterator[np.ndarray], n: int, least: np.ndarray, item_of: np.ndarray, first_cell: np.ndarray) -> np.ndarray:
    """Cells that hold, with the next cell, at least as many of the hits as their item needs."""
    count = None
    for c in cells:
        now = np.bincount(c, minlength=n + 1)
        count = now if count is None else count + now
    both = count[:-1] + count[1:]
    near = np.flatnonzero(both >= least.min())
    return near[both[near] >= least[item_of[np.searchsorted(first_cell, near, "right") - 1]]]


def near_pieces(part: np.ndarray, where: np.ndarray, item: np.ndarray, index: Index, similarity: float) -> np.ndarray:
    """Which items may lie near ``where``: an item within the bound has a piece that is, too (bit-parallel)."""
    good = np.zeros(len(where), bool)
    pieces = np.diff(index.first_piece)[item]
    # of like slack together, as all of a round go as many steps as the longest
    row = np.repeat(order := np.argsort(index.slack[item], kind="stable"), pieces[order])
    turn = np.arange(len(row)) - np.repeat(np.cumsum(pieces[order]) - pieces[order], pieces[order])
    one, masks = np.uint64(1), index.masks.ravel()
    for a in range(0, len(row), PIECES_AT_ONCE):
        rows = row[a : a + PIECES_AT_ONCE]
        own = item[rows]
        piece = index.first_piece[own] + turn[a : a + PIECES_AT_ONCE]
        size, slack = index.piece_size[piece], index.slack[own] + index.width[own]
        at = where[rows] + index.piece_at[piece] - slack
        top, line = one << (size - 1).astype(np.uint64), piece * 256
        plus, minus = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), np.uint64)
        now = size.astype(np.int16)
        best = now.copy()
        for step in range(int((size + 2 * slack).max())):
            eq = masks[line + part.take(at + step, mode="clip")]
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            now += (ph & top) != 0
            now -= ((mh & top) != 0).view(np.int8)
            np.minimum(best, now, out=best)
            ph <<= one
            mh <<= one
            plus, minus = mh | ~(xv | ph), ph & xv
        good[rows[best <= (1 - similarity) * size + 1e-9]] = True
    return good


def candidates(buffer: np.ndarray, index: Index, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(position, item) pairs: near where in the buffer an item would start that collides often enough.

    Each collision of a window of the buffer with one of an item says where the item would start.
    Edits move these starts by no more than the item's width, so those of one passage lie in
    neighbouring cells of that width, where they are counted.
    """
    where, items = [], []
    longest = int((index.lengths + 2 * index.slack).max(initial=0))
    chunk = max(WINDOWS_AT_ONCE, 4 * longest)
    for lo in range(0, len(buffer), chunk):
        at = np.flatnonzero(buffer[lo : lo + chunk + longest] > 32).astype(np.int32)
        part = buffer[lo : lo + chunk + longest + CLASSES[0][1] + 1]
        if not len(at):
            continue
        out = walk(part, at, index.moves)
        for table in index.tables:
            bits = (len(table.first) - 1).bit_length() - 1
            name = small_hash(pack(out, table.positions), bits)
            low = table.first[name]
            count = table.first[name + 1] - low
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            low, count, start = low[hit], count[hit], at[hit]
            own = np.unique(table.owner)
            cells_of = (len(part) + index.lengths[own]) // index.width[own] + 2
            first_cell = np.cumsum(cells_of) - cells_of
            place = np.zeros(len(index.texts), np.int64)
            place[own] = first_cell
            ends = np.cumsum(count, dtype=np.int64)
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(HITS_AT_ONCE, ends[-1], HITS_AT_ONCE), "right"), len(hit)])

            def cells(low=low, count=count, start=start, place=place, table=table, cuts=cuts) -> Iterator[np.ndarray]:
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    n, total = count[a:b], int(count[a:b].sum())
                    found = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(total)
                    item = table.owner[found]
                    yield place[item] + (np.repeat(start[a:b], n) - table.offset[found] + index.lengths[item]) // index.width[item]

            full = crowded(cells(), int(cells_of.sum()), index.least, own, first_cell)
            k = np.searchsorted(first_cell, full, "right") - 1
            item = own[k]
            start = (full - first_cell[k]) * index.width[item] + index.width[item] - index.lengths[item]
            where.append(start + lo)
            items.append(item)
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, items = np.concatenate(where), np.concatenate(items)
    near = near_pieces(buffer, where, items, index, similarity)
    return where[near], items[near]


def best_edit(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text`` and the part's end (bit-parallel)."""
    n = len(pattern)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    equal: dict[str, int] = {}
    for k, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << k
    plus, minus, now, best, end = mask, 0, n, n, 0
    for k, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & mask), plus & xh
        now += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & mask, mh << 1 & mask
        plus, minus = mh | (~(xv | ph) & mask), ph & xv
        if now < best:
            best, end = now, k
    return best, end


def matches(texts: list[str | None], index: Index, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(text number, item number, edit distance, characters of the item), the best of each pair."""
    norms = [normal(t).decode("utf-8", "ignore") for t in texts]
    out = short_matches(norms, index, similarity)
    if not index.tables:
        return out
    begins = np.cumsum([0, *(len(n) + 1 for n in norms)])
    buffer = folded("\x00".join(norms) + "\x00" * (CLASSES[0][1] + 1))
    where, items = candidates(buffer, index, similarity)
    # the passage lies in some text that the candidate, with its slack, reaches
    slacks, lengths = index.slack + index.width, index.lengths
    reach = lambda x: np.clip(np.searchsorted(begins, x, "right") - 1, 0, len(norms) - 1).tolist()
    spots: dict[tuple[int, int], list[int]] = {}
    for x, z, item, at in zip(reach(where - slacks[items]), reach(where + lengths[items] + slacks[items]), items.tolist(), where.tolist(), strict=True):
        for y in range(x, z + 1):
            spots.setdefault((y, item), []).append(at - int(begins[y]))
    for (x, item), starts in spots.items():
        pattern = index.texts[item]
        most = int((1 - similarity) * len(pattern) + 1e-9)
        slack = int(slacks[item])
        best = None
        starts.sort()
        k = 0
        while k < len(starts):
            lo = max(0, starts[k] - slack)
            hi = starts[k] + len(index.texts[item]) + slack
            while k + 1 < len(starts) and starts[k + 1] - slack <= hi:
                k += 1
                hi = starts[k] + len(index.texts[item]) + slack
            k += 1
            distance, _ = best_edit(pattern, norms[x][lo:hi])
            if distance <= most and (best is None or distance < best):
                best = distance
        if best is not None:
            out.append((x, item, best, len(pattern)))
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks whose index is of bounded size, fetched one partition at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        chars = len(r[1] or "")
        if block and (size + chars) * INDEX_BYTES_PER_CHAR > INDEX_BYTES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += chars
    if block:
        yield block


def found_in(docs: DataFrame, own: list[str], benchmark: DataFrame, similarity: float) -> DataFrame:
    """The columns ``own`` of ``docs`` (and its text) beside each item found in a row, and its distance.

    With more blocks than one the rows of each are written and its index is released before the next.
    """
    schema = StructType([*[docs.schema[c] for c in own], StructField("item_id", benchmark.schema["item_id"].dataType), *[StructField(c, LongType()) for c in ("edit_distance", "item_chars")], StructField("similarity", DoubleType())])
    blocks, parts = iter(item_blocks(benchmark)), []
    items = next(blocks, None)
    while items is not None:
        index, items = docs.sparkSession.sparkContext.broadcast(build_index(items, similarity)), next(blocks, None)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if rows := matches(b.column(b.num_columns - 1).to_pylist(), index.value, similarity):
                    x, item, distance, chars = map(np.array, zip(*rows, strict=True))
                    ids = pa.array([index.value.item_ids[k] for k in item.tolist()])
                    columns = [*[c.take(pa.array(x)) for c in b.columns[:-1]], ids, pa.array(distance), pa.array(chars), pa.array(1 - distance / chars)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        part = docs.select(*own, F.col("text").cast("string")).mapInArrow(run, schema)
        if parts or items is not None:
            part = materialise(part, "leaks")
            index.destroy()
        parts.append(part)
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edit_distance, item_chars, similarity): the items found in each document.

    An item is found where some part of the document, both lower-cased and with single blanks, is
    within ``1 - similarity`` of the item's characters by edit distance. Windows start at every
    character of a document and of an item, so an unedited passage always collides, wherever it
    stands; of an edited one the windows between the edits do. The recall of 0.95 or more holds for
    edits at random places. Substitutions at even distances leave the shortest stretches between
    them: of such items 0.83 to 1.00 were found at 15 % of edits and 0.40 to 0.80 at 20 %, all at
    10 % (figures of a probe, see the README). Items under LEAST_BYTES bytes have no windows and are
    found exactly, within the same bound (so under five characters whole).

    Items travel to the tasks in blocks, whose index takes INDEX_BYTES at most (one longer item is a
    block of its own); documents are read once a block and not shuffled. Null, empty and blank texts
    hold nothing, and such items are found nowhere. Very long texts are scanned in chunks that
    overlap by an item. Repeated documents are reported as often as they come, repeated items each
    under its id; null ids are kept. Extra columns are ignored; empty tables give no rows.
    """
    return found_in(docs, ["doc_id"], benchmark, similarity)


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, whole, that hold no item; with one block of items no shuffle.

    With more blocks the documents that hold an item are gathered first and left out by a join on
    what makes a document, its doc_id and text. Null and empty texts are clean. The rest is as in
    :func:`contaminated`.
    """
    blocks = list(islice(item_blocks(benchmark), 2))
    if len(blocks) == 2:
        keyed = docs.select(*document_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        bad = found_in(keyed.select("key", "tie", F.col("_row.text").alias("text")), ["key", "tie"], benchmark, similarity)
        return keyed.join(bad.select("key", "tie").distinct(), ["key", "tie"], "left_anti").select("_row.*")
    at = docs.columns.index("text")
    for items in blocks:
        index = docs.sparkSession.sparkContext.broadcast(build_index(items, similarity))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x for x, *_ in matches(b.column(at).to_pylist(), index.value, similarity)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
