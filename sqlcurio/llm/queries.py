"""The driver's queries over the llm operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcurio.llm import audit, decontaminate, langid, lines, mixing, negatives, oracles, pii, quality, repeats, sharding, simhash, spotsigs, urlrules
from sqlcurio.llm.common import table

URL_RULES = [
    urlrules.Rule("net", "/", "block"),
    urlrules.Rule("example.net", "/en/", "allow"),
    urlrules.Rule("example.com", "/de/", "block"),
    urlrules.Rule("org", "/fr/", "allow"),
]


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are every fiftieth vec_id; labels of every seventh are wrong by one, as from a noisy source."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), lambda i: i % 50 == 0)


QUERIES = {
    "op1_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")).drop("key", "tie"),
    "op2_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op3_langid": lambda spark, d: langid.identify(table(spark, d, "documents")),
    "op4_repeats": lambda spark, d: repeats.remove_repeats(table(spark, d, "documents")).drop("kept"),
    "op5_pii": lambda spark, d: pii.replace_pii(table(spark, d, "documents")),
    "op6_decontaminate": lambda spark, d: decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_lines": lambda spark, d: lines.kept_lines(table(spark, d, "documents")),
    "op8_sharding": lambda spark, d: sharding.assign_shards(table(spark, d, "documents")),
    "op9_urlrules": lambda spark, d: urlrules.judge(table(spark, d, "pages"), URL_RULES),
    "op10_quality": lambda spark, d: quality.quality(table(spark, d, "documents")),
    "op11_negatives": hard_negatives,
    "op12_audit": lambda spark, d: audit.audit_documents(table(spark, d, "documents"), table(spark, d, "labels")),
    "op13_spotsigs": lambda spark, d: spotsigs.with_edits(table(spark, d, "documents")),
}


ORACLES: dict[str, str] = {
    "op1_mixing": oracles.mixing_sql(),
    "op2_simhash": oracles.simhash_sql(),
    "op4_repeats": oracles.repeats_sql(),
    "op8_sharding": oracles.sharding_sql(),
    "op9_urlrules": oracles.url_rules_sql(URL_RULES),
    "op11_negatives": oracles.negatives_sql(),
    "op12_audit": oracles.audit_sql(),
    "op13_spotsigs": oracles.spotsigs_sql(),
}
