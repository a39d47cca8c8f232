"""End-to-end plans: enrich a corpus, draw a subset, evaluate predictions, choose models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcurio.functions.nl import analyze_question
from sqlcurio.functions.prompts import estimate_tokens, introduction_parts, schema_text, sql_prompt
from sqlcurio.functions.sqltext import analyze_sql, difficulty, extract_sql
from sqlcurio.functions.tagger import Tagger, tag
from sqlcurio.operators import evaluate, execute, retrieve, sampling
from sqlcurio.operators.convo import next_fit
from sqlcurio.plans.dispatch import converse_together
from sqlcurio.plans.providers import Provider, converse


def enrich(instances: DataFrame, tables: DataFrame | None = None, columns: DataFrame | None = None, tagger: Tagger | None = None) -> DataFrame:
    """question_analysis and sql_analysis beside each instance; names of tables and columns are joined once a db.

    With a ``tagger`` (see ``functions.tagger.fit``) entities are its own instead of those of the rules.
    """
    names = {}
    for kind, frame in (("table", tables), ("column", columns)):
        if frame is not None:
            packed = frame.groupBy("dataset", "db_id").agg(F.collect_set("name").alias(f"_{kind}s"))
            instances = instances.join(packed, ["dataset", "db_id"], "left")
            names[f"{kind}_names"] = F.coalesce(f"_{kind}s", F.array().cast("array<string>"))
    level = F.when(F.coalesce("difficulty", F.lit("unknown")) == "unknown", difficulty(F.col("sql"))).otherwise(F.col("difficulty"))
    out = instances.withColumn("question_analysis", analyze_question(F.col("question"), **names)).withColumn("sql_analysis", analyze_sql(F.col("sql")))
    out = out.withColumn("difficulty", level).drop("_tables", "_columns")
    if tagger is None:
        return out
    found = tag(out, tagger, "question", "_entities")
    types = F.array_distinct(F.transform("_entities", lambda e: e["label"]))
    analysis = F.col("question_analysis").withField("entities", F.col("_entities")).withField("entity_types", types).withField("has_entities", F.size("_entities") > 0)
    return found.withColumn("question_analysis", analysis).drop("_entities")


def proportional_subset(instances: DataFrame, target: int, key: str, by: str = "db_id", least: int = 1, seed: str = "42") -> DataFrame:
    quotas = sampling.proportional_quota(sampling.strata(instances, [by]), [by], target, least)
    return sampling.quota_sample(instances, quotas, [by], key, seed)


def predict(instances: DataFrame, provider: Callable[[], Provider], large: int = 6000, limit: int = 4000, at_once: int = 1, rate: float | None = None) -> DataFrame:
    """generated_sql by one conversation for each schema; rows need ``schema_tables``.

    Schemas of more than ``large`` tokens are introduced in chunks of about ``limit``, tables in order.
    A task holds up to ``at_once`` conversations at the same time, at ``rate`` calls a second where one is given.
    """
    key = F.concat_ws("_", "dataset", F.coalesce("database.type", F.lit("unknown")), "db_id")
    asked = instances.withColumn("schema_group", key)
    tables, tokens = F.col("schema_tables"), F.transform("schema_tables", lambda t: estimate_tokens(schema_text(F.array(t))))
    chunk = F.when(estimate_tokens(schema_text(tables)) > large, next_fit(tokens, limit)).otherwise(F.transform(tokens, lambda t: F.lit(0)))
    asked = asked.withColumn("_chunks", chunk).withColumn("introduction", introduction_parts(tables, F.col("_chunks"))).drop("_chunks")
    asked = asked.withColumn("prompt", sql_prompt(F.lit(""), F.col("question"), F.col("evidence")))
    together = at_once > 1 or rate is not None
    out = converse_together(asked, provider, "schema_group", "id", "introduction", at_once=at_once, rate=rate) if together else converse(asked, provider, "schema_group", "id", "introduction")
    return out.withColumn("generated_sql", extract_sql(F.col("raw_response"))).withColumn("has_prediction", F.col("generated_sql") != "")


def predict_and_execute(instances: DataFrame, provider: Callable[[], Provider], bag: bool = False) -> DataFrame:
    """Predictions with their execution verdicts over the session's views, exact matches and explanations."""
    executed = execute.check_executions(predict(instances, provider), bag=bag)
    return evaluate.evaluate(executed.withColumn("judged", F.lit(None).cast("boolean")))


def choose_models(queries: DataFrame, base: DataFrame, outcomes: DataFrame, k: int = 10) -> DataFrame:
    """The model with the highest weighted vote of each query's neighbours."""
    return retrieve.top_model(retrieve.vote(retrieve.knn(queries, base, k), outcomes))


def evaluate_predictions(predictions: DataFrame) -> DataFrame:
    return evaluate.metrics(evaluate.evaluate(predictions))
