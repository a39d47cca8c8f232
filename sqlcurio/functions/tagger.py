"""A trained tagger of entities: an averaged perceptron over sequences of words, decoded by Viterbi."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that features are hashed to; weights are this many rows of a number a tag.
PLACES = 1 << 15
#: Labelled rows that a tagger is fitted on at most, chosen by a hash of the text.
SAMPLE = 20_000
ENTITIES = "array<struct<text: string, label: string, start: int, end: int>>"
_WORD = re.compile(r"\w+(?:[.,]\d+)*|[^\w\s]")
_QUOTES = "\"'“”‘’`"


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), *m.span()) for m in _WORD.finditer(text)]


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", word)))


def features(words: list[tuple[str, int, int]]) -> list[np.ndarray]:
    """Places of what is known of each word: itself, its parts and shape, its neighbours, quotes about it."""
    low = [w.lower() for w, _, _ in words]
    shape, n = [_shape(w) for w, _, _ in words], len(words)
    quoted, inside = [], False
    for w, _, _ in words:
        inside ^= w in _QUOTES
        quoted.append(inside and w not in _QUOTES)
    at = lambda values, k: values[k] if 0 <= k < n else "^" if k < 0 else "$"
    out = []
    for k in range(n):
        known = [
            "b", f"w={low[k]}", f"s={shape[k]}", f"p={low[k][:3]}", f"e={low[k][-3:]}", f"q={quoted[k]}", f"qs={quoted[k]}{shape[k]}", f"1={k == 0}{shape[k]}", f"l={min(len(low[k]), 9)}{shape[k]}",
            f"-w={at(low, k - 1)}", f"+w={at(low, k + 1)}", f"-s={at(shape, k - 1)}{shape[k]}", f"+s={shape[k]}{at(shape, k + 1)}", f"-2={at(low, k - 2)}", f"+2={at(low, k + 2)}", f"--={at(low, k - 2)} {at(low, k - 1)}", f"++={low[k]} {at(low, k + 1)}", f"-+={at(low, k - 1)} {low[k]}",
        ]
        out.append(np.array([zlib.crc32(f.encode()) % PLACES for f in known]))
    return out


@dataclass
class Tagger:
    """Tags are O, and B- and I- of each label; ``moves`` weighs a tag behind another, from the start in its last row."""

    tags: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def best(self, known: list[np.ndarray]) -> list[int]:
        """The sequence of tags of the highest total; I- never follows another label."""
        if not known:
            return []
        score = np.stack([self.weights[f].sum(axis=0) for f in known])
        at, back = score[0] + self.moves[-1], []
        for s in score[1:]:
            total = at[:, None] + self.moves[:-1]
            back.append(total.argmax(axis=0))
            at = total.max(axis=0) + s
        path = [int(at.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def entities(self, text: str | None) -> list[dict]:
        words = words_of(text or "")
        out: list[dict] = []
        for (_, start, end), k in zip(words, self.best(features(words)), strict=True):
            kind, _, label = self.tags[k].partition("-")
            if kind == "B":
                out.append({"label": label, "start": start, "end": end})
            elif kind == "I":
                out[-1]["end"] = end
        return [{"text": text[e["start"] : e["end"]], **e} for e in out]


def _tags_of(words: list[tuple[str, int, int]], entities: list) -> list[str]:
    """Words that an entity covers, at least in part, are its; a word is of one entity."""
    out = ["O"] * len(words)
    for e in sorted(entities, key=lambda e: e["start"]):
        own = [k for k, (_, a, b) in enumerate(words) if a < e["end"] and b > e["start"] and out[k] == "O"]
        for n, k in enumerate(own):
            out[k] = ("I-" if n and own[n - 1] == k - 1 else "B-") + e["label"]
    return out


def train(rows: list[tuple[str, list]], rounds: int = 12, seed: int = 7) -> Tagger:
    """Rows (text, entities) in an order drawn anew each round; weights are averaged over all steps."""
    labels = sorted({e["label"] for _, entities in rows for e in entities})
    tags = ["O", *[f"{k}-{label}" for label in labels for k in "BI"]]
    number = {t: k for k, t in enumerate(tags)}
    never = np.array([[t.startswith("I-") and before not in (t, "B" + t[1:]) for t in tags] for before in [*tags, "^"]])
    known = [(features(words), [number[t] for t in _tags_of(words, entities)]) for words, entities in ((words_of(text), entities) for text, entities in rows)]
    weights, moves = np.zeros((PLACES, len(tags))), np.where(never, -1e9, 0.0)
    # weight * steps less what each change missed is the sum over all steps
    late_w, late_m, step, draw = np.zeros_like(weights), np.zeros_like(moves), 0, np.random.default_rng(seed)
    model = Tagger(tags, weights, moves)
    for _ in range(rounds):
        for k in draw.permutation(len(known)):
            seen, gold = known[k]
            said = model.best(seen)
            for n, (g, s) in enumerate(zip(gold, said, strict=True)):
                before = (gold[n - 1], said[n - 1]) if n else (-1, -1)
                if g != s:
                    for tag, by in ((g, 1.0), (s, -1.0)):
                        weights[seen[n], tag] += by
                        late_w[seen[n], tag] += by * step
                if (g, before[0]) != (s, before[1]):
                    for a, b, by in ((before[0], g, 1.0), (before[1], s, -1.0)):
                        moves[a, b] += by
                        late_m[a, b] += by * step
            step += 1
    done = max(step, 1)
    return Tagger(tags, weights - late_w / done, np.where(never, -1e9, moves - late_m / done))


def fit(labelled: DataFrame, text: str = "question", entities: str = "entities", sample: int = SAMPLE) -> Tagger:
    """A tagger of ``labelled`` (text, entities with label, start and end); at most about ``sample`` rows come to the driver."""
    rows = labelled.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.coalesce(F.col(entities), F.array().cast(ENTITIES)).alias("e")).distinct()
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("t"), F.lit(max(1, -(-n // sample)))) == 0).orderBy("t")
    return train([(r["t"], [e.asDict() for e in r["e"]]) for r in some.collect()])


def tag(df: DataFrame, tagger: Tagger, text: str = "question", out: str = "entities") -> DataFrame:
    """``df`` with the entities of each text: text, label, start and end. Weights are broadcast: a number a tag for each of PLACES.

    Null and empty texts have none. A long text costs time by its words times the square of the tags.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast(ENTITIES)).schema
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([shared.value.entities(t.as_py()) for t in b.column(text)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, out])

    return kept.mapInArrow(run, schema)
