"""spark-submit entry: enrich, profile or subset a corpus of question-to-SQL records."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sqlcurio.operators import profile
from sqlcurio.plans import process, reports
from sqlcurio.sources import readers, sinks


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sqlcurio", description=__doc__)
    parser.add_argument("command", choices=["enrich", "profile", "subset"])
    parser.add_argument("dataset", choices=sorted(readers.REGISTRY))
    parser.add_argument("source", nargs="+", help="the reader's paths, in its order")
    parser.add_argument("--out", required=True)
    parser.add_argument("--target", type=int, default=200)
    parser.add_argument("--limit", type=int)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("sqlcurio").getOrCreate()
    rows = process.enrich(readers.get_dataset(spark, given.dataset, *given.source, limit=given.limit))
    if given.command == "enrich":
        sinks.write_instances(rows, given.out)
    elif given.command == "profile":
        flat = rows.select("db_id", "difficulty", F.col("question_analysis.char_length").alias("question_length"), F.col("sql_analysis.char_length").alias("sql_length"), F.col("question_analysis.has_numbers").alias("has_numbers"))
        profile.profile(flat, ["question_length", "sql_length"], ["has_numbers"], db="db_id").write.mode("overwrite").json(given.out)
    else:
        chosen = process.proportional_subset(rows, given.target, "id")
        sinks.write_instances(chosen, given.out)
        print(reports.subset_report(rows, chosen, ["db_id", "difficulty"]))


if __name__ == "__main__":
    main()
