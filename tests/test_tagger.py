"""The tagger on held-out questions, its decoding against every sequence, and awkward rows."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sqlcurio.functions import nl, tagger
from sqlcurio.plans import process


def made(n, seed):
    """Questions with their entities by construction; names are drawn anew, so most of the held-out ones are unseen."""
    draw = random.Random(seed)
    name = lambda: "".join(draw.choices("bcdfglmnprst", k=1)).upper() + "".join(draw.choices("aeiourn", k=draw.randrange(3, 7)))
    out = []
    for _ in range(n):
        kinds = [
            ("What is the name of the singer called ", name(), "PERSON", "?"), ("How many people live in ", name(), "GPE", " today?"), ("List flights since ", str(draw.randrange(1900, 2030)), "DATE", " by airline."),
            ("Find countries with ", f"more than {draw.randrange(2, 900)}", "CARDINAL", " players."), ("Which ", draw.choice(["first", "second", "third"]), "ORDINAL", " prize was won most often?"), ("Count all matches and players", "", "", "."),
        ]
        before, what, label, after = draw.choice(kinds)
        out.append((before + what + after, [{"text": what, "label": label, "start": len(before), "end": len(before) + len(what)}] if what else []))
    return out


def test_held_out_questions(spark):
    labelled = spark.createDataFrame(made(600, 1), f"question string, entities {tagger.ENTITIES}")
    model = tagger.fit(labelled, sample=400)
    held = spark.createDataFrame([(k, q, e) for k, (q, e) in enumerate(made(300, 2))], f"id long, question string, want {tagger.ENTITIES}").repartition(3)
    rows = tagger.tag(held, model).collect()
    right = sum(r["entities"] == r["want"] for r in rows)
    by_rules = held.where(nl.entities(F.col("question")) == F.col("want")).count()
    assert len(rows) == 300 and right >= 285 and right > by_rules


def test_decoding_finds_the_best_of_all_sequences():
    draw = np.random.default_rng(3)
    tags = ["O", "B-X", "I-X", "B-Y", "I-Y"]
    never = np.array([[t.startswith("I-") and b not in (t, "B" + t[1:]) for t in tags] for b in [*tags, "^"]])
    model = tagger.Tagger(tags, draw.normal(size=(tagger.PLACES, 5)), np.where(never, -1e9, draw.normal(size=(6, 5))))
    for text in ("a", "two words", "one more, then", "five words are tagged here"):
        known = tagger.features(tagger.words_of(text))
        score = [model.weights[f].sum(axis=0) for f in known]
        total = lambda p: sum(s[t] for s, t in zip(score, p, strict=True)) + sum(model.moves[b, t] for b, t in zip((-1, *p), p, strict=False))
        assert tuple(model.best(known)) == max(itertools.product(range(5), repeat=len(known)), key=total)


def test_awkward_texts_and_enriched_instances(spark):
    model = tagger.fit(spark.createDataFrame([*made(200, 5), (None, []), ("", []), ("none", None)], f"question string, entities {tagger.ENTITIES}"))
    df = spark.createDataFrame([(None, 1), ("", 2), ("  \n", 3), ("née O'Neil—“x”", 4), ("word " * 3000, 5), ("How many people live in Lorano today?", 6)], "question string, entities int")
    found = {r["question"]: r["entities"] for r in tagger.tag(df, model).collect()}
    assert found[None] == found[""] == found["  \n"] == [] and len(found) == 6
    assert all(q[e["start"] : e["end"]] == e["text"] for q, es in found.items() for e in es)
    assert tagger.fit(spark.createDataFrame([], f"question string, entities {tagger.ENTITIES}")).entities("a b") == []
    instances = spark.createDataFrame([("d", "x", "How many people live in Lorano today?", "SELECT 1", "simple")], "dataset string, db_id string, question string, sql string, difficulty string")
    analysis = process.enrich(instances, tagger=model).first()["question_analysis"]
    assert analysis["entity_types"] == ["GPE"] and analysis["has_entities"] and analysis["entities"][0]["text"] == "Lorano"
    assert process.enrich(instances).first()["question_analysis"]["word_length"] == analysis["word_length"]
