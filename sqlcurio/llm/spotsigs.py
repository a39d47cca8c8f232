"""SpotSigs: chains of content words behind common words are a text's signatures. SQL expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlcurio.llm.common import NULL_KEY, document_key, materialise

# Very common words of English, German, French and Spanish
ANCHORS = (
    "a an and are as at be but by can do for from had has have he her his if in is it its not of on or she so that the their there they this to was we were which who will with you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind um und vom von war wie wird zu zum zur "
    "au aux avec ce ces cette comme dans de du elle en est et il ils je la le les leur mais ne nous ou où par pas plus pour que qui sa se ses son sont sur un une "
    "al con como del el ella ellos entre era este esta fue ha hay lo los las más me mi muy no nos o para pero por porque ser si sin sobre su sus también y ya"
).split()
#: A word is a run of letters, marks and digits.
LETTERS = r"[\p{L}\p{M}\p{N}]+"
#: Texts whose words are longer than this on average are read character by character.
LONG_WORDS = 24
#: Texts with fewer signatures than this carry the chains behind all other words too.
FEW = 16
#: Likeness below it counts as none, which prunes pairs by their lengths alone.
LEAST = 0.02
DIGITS = 8


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also within lambdas."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))
    spaced = lambda w: (F.size(w) > 0) & (F.length(F.array_join(w, "")) <= LONG_WORDS * F.size(w))
    return _let(words, lambda w: F.when(spaced(w), w).otherwise(F.regexp_extract_all(low, F.lit(r"[^\x20\x09-\x0D]"), F.lit(0))))


def fingerprint(text: Column, anchors: tuple[str, ...] | list[str] = ANCHORS) -> Column:
    """The set of a text's signatures, 8 hexadecimal digits each, in order, as one string.

    A signature is the hash of the two content words that follow a common word. Where there are fewer
    than ``FEW`` a colon follows, and the chains behind all other words; a text of one content word or
    none has its words for a single chain. Only a blank text has no signature at all (":").
    """
    mark = "\x01"
    # every content word behind a blank, with a mark for each common word that follows it
    marked = F.array_join(F.transform(tokens(text), lambda t: F.when(t.isin(*anchors), mark).otherwise(F.concat(F.lit(" "), t))), "")
    sign = lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)
    bare = lambda p: F.rtrim(p, F.lit(mark))
    listed = lambda signs: F.array_join(F.array_sort(signs), "")
    none = F.array().cast("array<string>")

    def chains(pieces: Column, behind_mark: bool) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(pieces) - 3), lambda k: pieces[k].endswith(mark) == F.lit(behind_mark))
        found = F.transform(places, lambda k: sign(F.concat(bare(pieces[k + 1]), F.lit(" "), bare(pieces[k + 2]))))
        return F.when(F.size(pieces) > 2, F.array_distinct(found)).otherwise(none)

    def whole(pieces: Column) -> Column:
        one = F.array_join(pieces, " ")
        rest = lambda spots: F.when(F.size(pieces) > 2, F.array_except(chains(pieces, False), spots)).when(one == "", none).otherwise(F.array(sign(one)))
        return _let(chains(pieces, True), lambda s: F.when(F.size(s) >= FEW, listed(s)).otherwise(F.concat(listed(s), F.lit(":"), listed(rest(s)))))

    return _let(F.split(marked, " "), whole)


def packed(print_: Column) -> Column:
    """A fingerprint as bytes, half as long, for a shuffle; what follows a colon is null where there is none."""
    return F.struct(F.unhex(F.substring_index(print_, ":", 1)).alias("spots"), F.when(print_.contains(":"), F.unhex(F.substring_index(print_, ":", -1))).alias("rest"))


def unpacked(bytes_: Column) -> Column:
    digits = lambda b: F.lower(F.hex(b))
    return F.concat(digits(bytes_["spots"]), F.coalesce(F.concat(F.lit(":"), digits(bytes_["rest"])), F.lit("")))


def length_partition(size: Column, least: float = LEAST) -> Column:
    """Sets that are alike by ``least`` or more lie in the same or in neighbouring partitions of their sizes."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(least))


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two fingerprints, 0 where it is below ``least``.

    Two texts of few signatures are compared by all their chains, others by those behind common words.
    Pairs of partitions that are no neighbours, and pairs whose sizes alone keep them below ``least``,
    are settled without a look at the sets.
    """
    few = a.contains(":") & b.contains(":")
    part = lambda f: F.when(few, F.translate(f, ":", "")).otherwise(F.substring_index(f, ":", 1))
    cut = lambda f: F.regexp_extract_all(f, F.lit(f".{{{DIGITS}}}"), F.lit(0))

    def compared(own: Column) -> Column:
        x, y = own["x"], own["y"]
        n, m = F.length(x) / DIGITS, F.length(y) / DIGITS
        shared = F.size(F.array_intersect(cut(x), cut(y)))
        alike = _let(shared, lambda s: s / (n + m - s))
        apart = F.abs(length_partition(n, least) - length_partition(m, least)) > 1
        return F.when(x == y, 1.0).when(apart | (F.least(n, m) < least * F.greatest(n, m)), 0.0).otherwise(_let(alike, lambda j: F.when(j >= least, j).otherwise(0.0)))

    return _let(F.struct(part(a).alias("x"), part(b).alias("y")), compared)


def following(documents: DataFrame) -> DataFrame:
    """``documents`` (key, tie, n) with next_key and next_tie, the next one by descending key and tie, the first after the last.

    Rows are dealt by ranges and written; each range knows its own followers, and the last row of one
    is followed by the head of the next range that has any, from a table of one row a range.
    """
    count = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("key"), F.desc("tie")]
    dealt = materialise(documents.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()), "spotsigs-order")
    heads = dealt.groupBy("_range").agg(F.max(F.struct("key", "tie")).alias("_head"))
    every = Window.partitionBy(F.lit(0)).orderBy("_range")
    heads = heads.select("_range", F.coalesce(F.lead("_head").over(every), F.first("_head").over(every)).alias("_then"))
    own = dealt.withColumn("_next", F.lead(F.struct("key", "tie")).over(Window.partitionBy("_range").orderBy(*order)))
    found = own.join(F.broadcast(heads), "_range").withColumn("_next", F.coalesce("_next", "_then"))
    return found.select("key", "tie", "n", F.col("_next.key").alias("next_key"), F.col("_next.tie").alias("next_tie"))


def with_edits(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of ``docs`` (doc_id, text).

    The edited text ends in the first characters of the next document by descending doc_id instead of
    its own last half; the first document follows the last. Rows that repeat doc_id and text are one
    document in that order and give a row each; rows of one doc_id with different texts, and null
    doc_ids (before all others), follow one another by a hash of the text. Null is the empty text. A
    very long text is read whole by one task. A single document follows itself; no rows in, no rows
    out; other columns are ignored; a doc_id that is no whole number is refused.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = following(docs.select(*document_key(docs), F.length(text).alias("n")).distinct())
    # each text is fingerprinted once, before both joins, whose sides are the same exchange
    texts = docs.select(*document_key(docs), text.alias("text"), packed(fingerprint(text)).alias("fingerprint"))
    halves = order.select(F.col("key").alias("to_key"), F.col("tie").alias("to_tie"), F.floor(F.col("n") / 2).cast("int").alias("half"), F.col("next_key").alias("key"), F.col("next_tie").alias("tie"))
    given = texts.join(halves, ["key", "tie"]).select(F.col("to_key").alias("key"), F.col("to_tie").alias("tie"), "half", F.expr("left(text, half)").alias("tail"), F.col("fingerprint").alias("next_fingerprint"))
    given = given.groupBy("key", "tie").agg(F.first("half").alias("half"), F.first("tail").alias("tail"), F.first("next_fingerprint").alias("next_fingerprint"))
    both = texts.join(given, ["key", "tie"]).withColumn("n_chars", F.length("text")).withColumn("edited", F.concat(F.expr("left(text, n_chars - half)"), F.col("tail")))
    both = both.select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), unpacked(F.col("fingerprint")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), unpacked(F.col("next_fingerprint")).alias("next_fingerprint"))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), least)
    return both.withColumn("near_edited", near("edited_fingerprint")).withColumn("near_next", near("next_fingerprint")).drop("next_fingerprint")
