"""What filters remove in every order: a trie of orders walked over persisted survivors, states shared by their sets."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcurio.llm.common import NULL_KEY, WORD, document_key, materialise

#: Orders grow with the factorial of the filters: 720 of them, and 192 edges, at six.
MOST_FILTERS = 6


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions of a text alone: short, repetitive, shouting, marked up."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, repeat: str = "E", part: str = "source") -> DataFrame:
    """(part, good, toxic and a boolean for each filter) of every row of ``docs``, true where it fails.

    ``repeat`` names the filter of texts that equal the text of a smaller doc_id anywhere in the table;
    a null doc_id is behind all others, and equal ones are not smaller. Texts are read once and meet as
    SHA-256; null is the empty text. A document is good or toxic if any of its rows in ``labels`` says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rules = text_rules(text)
    own = docs.select(document_key(docs)[0], F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_text"), *[c.alias(name) for name, c in rules.items()])
    own = materialise(own, "audit-texts")
    copied = own.groupBy("_text").agg(F.min("key").alias("_first"), F.max("key").alias("_last")).where("_first < _last").drop("_last")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # written, so that both sides of each join come straight from an exchange and a text or a null id with very many rows is split
    copied, said = materialise(copied, "audit-copies"), materialise(said.where(F.col("key") != NULL_KEY), "audit-labels")
    both = own.join(copied, "_text", "left").withColumn(repeat, F.coalesce(F.col("_first") < F.col("key"), F.lit(False))).drop("_text", "_first")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return both.join(said, "key", "left").select("part", *rules, repeat, flag("good"), flag("toxic"))


def edges(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, state, filter, kept, removed, good_lost, toxic_lost) of every edge of the trie of orders.

    A state is the set of the filters applied before, as its sorted names. The walk goes depth first:
    a state's survivors are what the next filter leaves of its parent's, persisted while states below
    read them; another prefix of the same filters finds its state counted already. All edges that
    leave a state are counted in one pass over its survivors. At most one branch is persisted at a
    time, spilling to disk; lost parts are made again from the written rows.
    """
    counted: dict[str, DataFrame] = {}

    def visit(state: str, survivors: DataFrame) -> None:
        left = [f for f in names if f not in state]
        fails = [(f, F.col(f)) for f in left]
        counts = [F.struct(F.lit(f).alias("filter"), F.count_if(~c).alias("kept"), F.count_if(c).alias("removed"), F.count_if(c & F.col("good")).alias("good_lost"), F.count_if(c & F.col("toxic")).alias("toxic_lost")) for f, c in fails]
        leaving = survivors.groupBy("part").agg(F.array(*counts).alias("_edges")).select("part", F.lit(state).alias("state"), F.explode("_edges").alias("_edge")).select("part", "state", "_edge.*")
        counted[state] = materialise(leaving, "audit-edges")
        for f in left:
            child = "".join(sorted(state + f))
            if child in counted or len(left) == 1:
                continue
            below, read_again = survivors.where(~F.col(f)), len(left) > 2
            if read_again:
                below = below.persist(StorageLevel.MEMORY_AND_DISK)
            visit(child, below)
            if read_again:
                below.unpersist()

    visit("", rows)
    return reduce(DataFrame.unionAll, counted.values())


def audit(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, from ``rows`` (part, good, toxic, a boolean for each name).

    ``names`` are single letters, true where a row fails. Counts within the part: kept and removed by
    the step, redundant (failing its filter but removed before), unique_fails (failing no other),
    good_lost, toxic_lost, and shapley, the filter's removals summed over all orders. Parts without a
    row left at a step have zeros there. No rows in, no rows out; repeated rows all count.
    """
    if len(names) > MOST_FILTERS or len(set(names)) < len(names) or any(len(f) != 1 for f in names):
        raise ValueError(f"filters must be at most {MOST_FILTERS} different single letters")
    names = sorted(names)
    walked = materialise(edges(rows, names), "audit-trie")
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(names)]))
    steps = rows.groupBy("part").agg(F.map_from_arrays(F.array(*[F.lit(f) for f in names]), F.array(*[F.struct(F.count_if(F.col(f)).alias("fails"), F.count_if(reduce(lambda a, b: a & b, [F.col(f), *[~F.col(g) for g in names if g != f]])).alias("only")) for f in names])).alias("_of"))
    steps = steps.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    steps = steps.select("part", "filter_order", "step", F.expr("substring(filter_order, step, 1)").alias("filter"), F.array_join(F.array_sort(F.split(F.expr("substring(filter_order, 1, step - 1)"), "")), "").alias("state"), "_of")
    orders_through = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), F.length("state") + 1)
    shares = walked.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders_through).alias("shapley"))
    joined = steps.join(walked, ["part", "state", "filter"], "left").join(shares, ["part", "filter"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    mine = F.col("_of")[F.col("filter")]
    return joined.select("part", "filter_order", "step", count("kept"), count("removed"), (mine["fails"] - F.coalesce("removed", F.lit(0))).alias("redundant"), mine["only"].alias("unique_fails"), count("good_lost"), count("toxic_lost"), count("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit` of the filters of :func:`text_rules` and of repeated texts over ``docs``, a part for each source.

    Null and empty texts are short and equal to one another; very long texts are read whole; a null
    source is the part of the empty string; other columns are ignored.
    """
    rows = materialise(judged(docs, labels), "audit-rows")
    return audit(rows, ["A", "B", "C", "D", "E"])
