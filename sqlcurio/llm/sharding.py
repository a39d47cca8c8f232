"""Shards along a Hilbert curve over quantised metadata, for file pruning in several dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlcurio.llm.common import materialise


#: Ways to which a cell's rows are dealt where cells are too many to broadcast.
SALTS = 64


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of the cell whose coordinates are ``axes``, each of ``bits`` bits.

    The usual transposed transform: undo the excess work bit by bit from the highest, Gray-encode,
    then interleave. One higher-order fold keeps the expression small.
    """
    n = len(axes)
    state = F.struct(*[a.cast("int").alias(f"x{k}") for k, a in enumerate(axes)])
    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])

    def undo(s: Column, q: Column) -> Column:
        x, low = [s[f"x{k}"] for k in range(n)], q - 1
        for k in range(n):
            is_set = x[k].bitwiseAND(q) != 0
            if k == 0:
                x[0] = F.when(is_set, x[0].bitwiseXOR(low)).otherwise(x[0])
            else:
                t = x[0].bitwiseXOR(x[k]).bitwiseAND(low)
                x[0], x[k] = (
                    F.when(is_set, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(t)),
                    F.when(is_set, x[k]).otherwise(x[k].bitwiseXOR(t)),
                )
        return F.struct(*[v.alias(f"x{k}") for k, v in enumerate(x)])

    def finish(s: Column) -> Column:
        gray = [s["x0"]]
        for k in range(1, n):
            gray.append(s[f"x{k}"].bitwiseXOR(gray[-1]))
        flips = F.aggregate(levels, F.lit(0), lambda t, q: F.when(gray[-1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for g in gray:
                bit = F.shiftright(g.bitwiseXOR(flips), b).bitwiseAND(F.lit(1)).cast("long")
                out = F.shiftleft(out, 1).bitwiseOR(bit)
        return out

    return F.aggregate(levels, state, undo, finish) if bits > 1 else F.aggregate(F.array(F.lit(1)), state, lambda s, q: s, finish)


def levels_of(slim: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, level): the values of ``column`` in order, null last, cut into 2^bits equal parts by rows."""
    counts = slim.groupBy(column).agg(F.count("*").alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col(column).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_n") / 2
    level = F.floor(middle * (1 << bits) / F.sum("_n").over(everything))
    return counts.select(F.col(column).alias("_value"), F.least(level, F.lit((1 << bits) - 1)).cast("int").alias("_level"))


def assign_shards(
    docs: DataFrame,
    shards: int = 16,
    axes: tuple[str, ...] = ("source", "lang"),
    bits: int = 5,
    bucket_rows: int = 192,
    most_buckets: int = 8192,
) -> DataFrame:
    """Shard and slot of each row of ``docs`` (doc_id, text and the ``axes``), law ``rows``.

    The axes and the logarithm of the text's size are quantised to ``bits`` bits, the rows put in
    the order of their cell on the Hilbert curve, and the order cut into ``shards`` runs whose
    counts differ by one at most. Row numbers need no global sort: cells, and hash ranges of cells
    with many rows, are counted; the counts' prefix sums place each bucket, and only a bucket's own
    rows are sorted together. Buckets number at most 2^(bits * dimensions) + ``most_buckets``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``text_crc32`` that of its bytes (null: as
    empty), ``slot`` the gapless place in the shard. ``grown_shard`` is null under this law. Null
    axes come last in their dimension. Rows alike in all but doc_id lie in the order of a hash of
    doc_id; repeated rows take a slot each. An empty table gives no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    slim = materialise(docs.select("doc_id", *[F.col(a).cast("string").alias(f"_axis{k}") for k, a in enumerate(axes)], size.alias("size"), crc.alias("text_crc32")), "shard-slim")
    placed = slim
    for k in range(len(axes)):
        level = levels_of(slim, f"_axis{k}", bits)
        placed = placed.join(level, placed[f"_axis{k}"].eqNullSafe(level["_value"])).drop("_value").withColumnRenamed("_level", f"_level{k}")
    scale = F.least(F.greatest(F.floor(2 * F.log2("size")) - 8, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")
    cell = hilbert_index([*[F.col(f"_level{k}") for k in range(len(axes))], scale], bits)
    placed = materialise(placed.select("doc_id", "size", "text_crc32", cell.alias("_cell"), F.shiftrightunsigned(F.xxhash64("doc_id"), 33).alias("_lot")), "shard-cells")

    cells = placed.groupBy("_cell").agg(F.count("*").alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    aim = F.greatest(F.lit(bucket_rows), F.ceil(F.sum("_n").over(everything) / most_buckets))
    cells = cells.select("_cell", F.greatest(F.ceil(F.col("_n") / aim), F.lit(1)).cast("long").alias("_parts"))
    # a row per cell: broadcast where the number of cells is bound to be small. Else rows would be
    # dealt by cell, and the split of a hot cell undone, as its parts would stay where the cell is.
    if bits * (len(axes) + 1) <= 16:
        cells = F.broadcast(cells)
    else:
        cells = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = placed.withColumn("_salt", (F.col("_lot") % SALTS).cast("int"))
    placed = placed.join(cells, [c for c in cells.columns if c != "_parts"]).withColumn("_part", F.shiftright(F.col("_lot") * F.col("_parts"), 31))
    before = everything.orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("_cell", "_part").agg(F.count("*").alias("_n"))
    buckets = buckets.select("_cell", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias("_total"))
    own = Window.partitionBy("_cell", "_part").orderBy("_lot", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("_own", F.row_number().over(own)).join(buckets, ["_cell", "_part"])
    place = F.col("_before") + F.col("_own") - 1
    # shard s holds the places from ceil(s * total / shards) on
    shard = F.expr(f"(_before + _own - 1) * {shards} div _total")
    first = F.expr(f"(_shard * _total + {shards - 1}) div {shards}")
    ranked = ranked.withColumn("_place", place).withColumn("_shard", shard).withColumn("_first", first)
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_place") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_cell").alias("curve_index"),
    )
