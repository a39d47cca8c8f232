"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlcurio.llm.common import WORD, document_key, materialise, sainte_lague


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lottery(seed: int, name: Column) -> Column:
    """A number below 2^60 that ``name`` draws with ``seed``."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), name)), F.lit(1), F.lit(15)), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source_size, weight and target of each source of ``sizes`` (source, source_size).

    Sources in order of their names, null last, take the weights in turn. Together they share
    ``share`` of all words; a target stops at ``most`` times its source and the excess goes to the
    others by weight. With the sources in order of cap / weight the level that fills the rest is
    found by prefix sums, so no rounds are needed.
    """
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    first = everything.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    df = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", share * F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(first), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(first), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_rest"))
        .withColumn("_full", F.col("_ratio") <= F.col("_level"))
        # sources that are not full all share the level of the first of them
        .withColumn("_at", F.min(F.when(~F.col("_full"), F.col("_ratio"))).over(everything))
        .withColumn("_at_level", F.min(F.when(F.col("_ratio") == F.col("_at"), F.struct(F.col("source").isNull(), "source", "_level"))).over(everything))
    )
    level = F.col("_at_level._level")
    return df.select(
        "source", "source_size", "weight", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * level).cast("double").alias("target")
    )


def mix(
    docs: DataFrame,
    weights: list[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 16,
    shard_rows: int = 128,
    most_shards: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """Columns of the mix for each row of ``docs`` (doc_id, text, source).

    A source's target is a number of blocks of ``block_words`` words. Its documents are dealt by a
    seeded hash to shards; Sainte-Lague gives each source its blocks and then each of its shards an
    integer quota. In a shard the documents lie in seeded order and are cut into equal blocks (the last
    may be short); the
    quota picks blocks at even steps from a seeded start, a block at most ``most`` times over. A
    document takes the words of the picked blocks that fall in it, so ``taken`` needs no row per block.

    Shards per source grow with its rows to ``most_shards``, so a source with a third of all rows is
    spread and the quota table stays within sources x most_shards rows.

    ``key`` and ``tie`` name the row's document: doc_id and text, as rows may share a doc_id or have none.

    Null text or a text without words: size 0, taken 0. A very long text is a run of blocks like any
    other. Null source: a source of its own, last. An empty table gives no rows. Repeated rows are
    kept, each with its own share. Extra columns are ignored. Ties in the seeded order go by
    document. A doc_id that is no whole number is refused.
    """
    slim = materialise(docs.select("doc_id", *document_key(docs), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    per_source = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(per_source.select("source", "source_size"), list(weights), share, most)
    per_source = per_source.withColumn("_shards", F.least(F.ceil(F.col("_rows") / shard_rows), F.lit(most_shards)).cast("long"))
    seats = (
        targets.withColumn("_order", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long"))
    )
    seats = sainte_lague(seats, [], "target", "_seats", "_order", "_blocks")
    plan = per_source.drop("source_size").alias("p").join(seats.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    plan = materialise(plan.select("s.source", "source_size", "target", "_order", "_blocks", "_shards"), "mix-plan")

    # the plan has a row per source; sources are few beside documents, and AQE splits a hot one
    placed = slim.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string")))
    placed = placed.select(
        "doc_id", "key", "tie", "size", "source_size", "target", "_order", "_blocks", lottery(seed, name).alias("_lot"), (lottery(seed + 1, name) % F.col("_shards")).alias("_shard")
    )
    lengths = placed.groupBy("_order", "_shard").agg(F.sum("size").alias("_length"), F.first("_blocks").alias("_blocks"))
    quotas = sainte_lague(lengths, ["_order"], "_length", "_blocks", "_shard", "_quota")
    quotas = quotas.where("_length > 0").withColumn("_step", F.lit(block_words).cast("long"))
    quotas = quotas.withColumn("_m", F.ceil(F.col("_length") / F.col("_step")).cast("long"))
    quotas = quotas.withColumn("_q", F.least(F.col("_quota"), (F.col("_m") * most).cast("long")))
    quotas = quotas.withColumn("_start", lottery(seed + 2, F.concat_ws(":", F.col("_order").cast("string"), F.col("_shard").cast("string"))) % F.col("_m")).select("_order", "_shard", "_step", "_m", "_q", "_start")

    run = Window.partitionBy("_order", "_shard").orderBy("_lot", "key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("_end", F.sum("size").over(run)).join(quotas, ["_order", "_shard"], "left")
    picked = lambda k: F.expr(f"({k} + _start) * _q div _m - _start * _q div _m")  # noqa: E731  picks among the first k blocks

    def words_before(x: str) -> Column:
        block = f"({x} div _step)"
        return picked(block) * F.col("_step") + (picked(f"({block} + 1)") - picked(block)) * F.expr(f"{x} % _step")

    taken = words_before("_end") - words_before("(_end - size)")
    return laid.select("doc_id", "size", "source_size", "target", F.coalesce(F.when(F.col("size") > 0, taken), F.lit(0)).cast("long").alias("taken"), "key", "tie")
