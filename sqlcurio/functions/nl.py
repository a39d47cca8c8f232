"""Question analysis by rules, as native expressions.

The rules stand in for a statistical tagger: numbers, negation and degree words come from short
lexicons and suffixes, entities from patterns. Another back end may replace any field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "hundred", "thousand", "million", "billion"]
NEGATIONS = ["not", "never", "nor", "neither", "n't"]
COMPARATIVES = ["more", "less", "fewer", "greater", "higher", "lower", "larger", "smaller", "better", "worse", "older", "younger", "earlier", "later", "bigger", "longer", "shorter", "taller", "heavier", "lighter", "faster", "slower", "cheaper", "newer"]
SUPERLATIVES = ["most", "least", "fewest", "greatest", "highest", "lowest", "largest", "smallest", "best", "worst", "oldest", "youngest", "earliest", "latest", "biggest", "longest", "shortest", "tallest", "heaviest", "lightest", "fastest", "slowest", "cheapest", "newest"]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "their", "to", "was", "what", "which", "who", "with"]
ENTITY_FLAGS = ["DATE", "TIME", "PERSON", "ORG", "GPE", "LOC", "MONEY", "PERCENT", "CARDINAL"]
ENTITY_PATTERNS = {
    "DATE": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)(?: [0-9]{1,2})?(?:,? [0-9]{4})?)\b",
    "TIME": r"\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b",
    "MONEY": r"[$][0-9][0-9,.]*",
    "PERCENT": r"\b[0-9]+(?:[.][0-9]+)?%",
    "CARDINAL": r"\b(?:[0-9]+|two|three|four|five|six|seven|eight|nine|ten|hundred|thousand|million)\b",
    "ORDINAL": r"\b(?:first|second|third|[0-9]+(?:st|nd|rd|th))\b",
}
TOKEN = r"[A-Za-z]+(?:'[a-z]+)?|[0-9]+(?:[.,][0-9]+)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


def lemma(word: Column) -> Column:
    """A crude singular: ies to y, then a final s that is not ss dropped."""
    low = F.lower(word)
    return F.when(low.rlike("[a-z]{2}ies$"), F.regexp_replace(low, "ies$", "y")).when(low.rlike("[a-z]{2}[^s]s$"), F.regexp_replace(low, "s$", "")).otherwise(low)


def terms(text: Column) -> Column:
    """Distinct lower-case alphabetic tokens that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.transform(tokens(text), lambda t: F.lower(t))
    return F.array_distinct(F.filter(words, lambda t: t.rlike("^[a-z]+$") & ~F.array_contains(stop, t)))


def entities(text: Column) -> Column:
    """array<struct<text, label, start, end>>, by label, then place; offsets count from 0."""
    return F.concat(*[_entities_of(text, label, pattern) for label, pattern in ENTITY_PATTERNS.items()])


def _entities_of(text: Column, label: str, pattern: str) -> Column:
    # the text is gap, word, gap, word, ..., gap
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda gap, word: F.struct(F.length(gap).alias("gap"), word.alias("word")))
    nothing = F.struct(F.array().cast("array<struct<text:string,label:string,start:int,end:int>>").alias("found"), F.lit(0).alias("at"))

    def step(s: Column, pair: Column) -> Column:
        start = s["at"] + pair["gap"]
        end = start + F.length(pair["word"])
        one = F.struct(pair["word"].alias("text"), F.lit(label).alias("label"), start.alias("start"), end.alias("end"))
        return F.struct(F.concat(s["found"], F.array(one)).alias("found"), end.alias("at"))

    return F.aggregate(F.filter(pairs, lambda p: p["word"].isNotNull()), nothing, step, lambda s: s["found"])


def analyze_question(question: Column, table_names: Column | None = None, column_names: Column | None = None) -> Column:
    """The question's metrics; overlaps with a schema's names when these are given."""
    text = F.coalesce(question, F.lit(""))
    # words and entities are bound to a lambda's variable: expressions that hold lambdas aren't shared otherwise
    parts = F.array(F.struct(tokens(text).alias("words"), entities(text).alias("found")))
    return F.transform(parts, lambda p: _analysis(text, p["words"], p["found"], table_names, column_names))[0]


def _analysis(text: Column, words: Column, found: Column, table_names: Column | None, column_names: Column | None) -> Column:
    low = lambda values: F.array(*map(F.lit, values))
    pick = lambda values: F.filter(words, lambda t: F.array_contains(low(values), F.lower(t)))
    numbers = F.filter(words, lambda t: t.rlike("^[0-9]") | F.array_contains(low(NUMBER_WORDS), F.lower(t)))
    negation = F.filter(words, lambda t: F.array_contains(low(NEGATIONS), F.lower(t)) | F.lower(t).endswith("n't"))
    comparatives, superlatives = pick(COMPARATIVES), pick(SUPERLATIVES)
    fields = [
        F.length(text).alias("char_length"), F.size(words).alias("word_length"),
        found.alias("entities"), F.array_distinct(F.transform(found, lambda e: e["label"])).alias("entity_types"), (F.size(found) > 0).alias("has_entities"),
        numbers.alias("numbers"), (F.size(numbers) > 0).alias("has_numbers"),
        (F.size(negation) > 0).alias("has_negation"), negation.alias("negation_words"),
        comparatives.alias("comparatives"), (F.size(comparatives) > 0).alias("has_comparatives"),
        superlatives.alias("superlatives"), (F.size(superlatives) > 0).alias("has_superlatives"),
    ]
    for name, names in (("table", table_names), ("column", column_names)):
        if names is not None:
            exact, by_lemma = overlap(text, names)
            fields += [exact.alias(f"{name}_overlap_count"), by_lemma.alias(f"{name}_overlap_lemma_count")]
    return F.struct(*fields)


def overlap(text: Column, names: Column) -> tuple[Column, Column]:
    """How many distinct names occur among the text's terms: as they are, and by lemma."""
    own = F.array_distinct(F.transform(names, lambda n: F.lower(n)))
    found = terms(text)
    lemmas = lambda a: F.array_distinct(F.transform(a, lemma))
    return F.size(F.array_intersect(own, found)), F.size(F.array_intersect(lemmas(own), lemmas(found)))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    return F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))


def similarity_stats(question_vector: Column, name_vectors: Column) -> Column:
    """Mean and largest cosine of the question's vector with the names' vectors."""
    # the question's length and the cosines are bound to lambdas' variables, so that each is worked out once
    asked = F.array(F.struct(question_vector.alias("v"), F.sqrt(_dot(question_vector, question_vector)).alias("n")))
    near = lambda q, v: F.coalesce(F.try_divide(_dot(q["v"], v), q["n"] * F.sqrt(_dot(v, v))), F.lit(0.0))
    all_of = F.transform(asked, lambda q: F.transform(name_vectors, lambda v: near(q, v)))
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), F.size(c))
    stats = lambda c: F.struct(F.coalesce(mean(c), F.lit(0.0)).alias("avg_similarity"), F.coalesce(F.array_max(c), F.lit(0.0)).alias("max_similarity"))
    return F.transform(all_of, stats)[0]
