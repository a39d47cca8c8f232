"""Queries over the driver's tables, one or more for each operator, with the same in DuckDB SQL.

``documents`` plays the corpus: source is the database, lang the difficulty. Statements, questions
and replies are made from columns by expressions that both engines read (SIM_*).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcurio.functions import nl, prompts, sqltext
from sqlcurio.operators import convo, evaluate, execute, features, ivf, profile, retrieve, sampling, standardize
from sqlcurio.operators.shared import shared_path, spread
from sqlcurio.plans import duck
from sqlcurio.plans.providers import EchoProvider, hashed_embedding
from sqlcurio.plans.process import enrich, predict
from sqlcurio.sources import ddl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, fractions as double rounded to 6 places, arrays joined by commas."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind in ("int", "smallint", "tinyint"):
            x = x.cast("long")
        elif kind in ("float", "double") or kind.startswith("decimal"):
            x = F.round(x.cast("double"), 6)
        elif kind == "array<string>":
            x = F.array_join(x, ",")
        out.append(x.alias(c))
    return df.select(out)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, d: plain(f(spark, d))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def q(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


# Simulated text

SIM_SQL = """CASE {k} % 9
 WHEN 0 THEN concat('SELECT * FROM orders WHERE o_custkey = ', cast({k} as string))
 WHEN 1 THEN concat('select count(*), max(o_totalprice) from "orders" join customer on o_custkey = c_custkey where c_nationkey = ', cast({k} % 25 as string), ' AND c_acctbal > 0 group by c_mktsegment having count(*) > 3 order by 2 limit 5')
 WHEN 2 THEN concat('SELECT o_orderkey, (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) FROM orders  LIMIT ', cast({k} % 7 as string))
 WHEN 3 THEN concat('SELECT avg(l_tax), sum(l_quantity * (1 - l_discount)), min(l_shipdate) FROM lineitem WHERE l_tax BETWEEN 0 AND 1 OR l_linenumber IN (1, 2, ', cast({k} % 9 as string), ') ORDER BY l_tax')
 WHEN 4 THEN concat('SELECT c_name FROM customer EXCEPT SELECT s_name FROM [supplier]; SELECT ', cast({k} as string))
 WHEN 5 THEN concat('Select upper(c_name) AS n FROM customer WHERE c_name LIKE ', chr(39), 'from Group  by', chr(39), ' and c_custkey <> ', cast({k} as string))
 WHEN 6 THEN ''
 WHEN 7 THEN concat('WITH t AS (SELECT a, coalesce(b, max(c, (d))) FROM x) SELECT ', repeat('a.b + ', cast({k} % 40 as int)), '1 FROM t JOIN y ON t.a = y.a WHERE t.a IS NOT NULL')
 ELSE concat('SELECT ', cast({k} as string)) END"""
SIM_QUESTION = """CASE {k} % 6
 WHEN 0 THEN concat('How many orders were not older than 30 days for customer ', cast({k} as string), '?')
 WHEN 1 THEN 'Which customers have more than five orders and the highest balance?'
 WHEN 2 THEN concat('List the names of segments since 2019-03-0', cast({k} % 9 + 1 as string), ' at 10:30, at most $1,200.50 or 12% of all')
 WHEN 3 THEN 'Never show smaller or larger countries without a name'
 WHEN 4 THEN 'Segment'
 ELSE '' END"""
SIM_REPLY = """CASE (conv_id + turn) % 7
 WHEN 0 THEN concat('<think>first SELECT x</think>```sql', chr(10), 'SELECT a FROM t', cast(turn as string), chr(10), '```')
 WHEN 1 THEN concat('{"sql": "SELECT b', chr(10), 'FROM t', cast(turn as string), '", "why": "so"}')
 WHEN 2 THEN concat('Here: ```', chr(10), 'select c from t', cast(turn as string), ' ```')
 WHEN 3 THEN concat('I think SELECT d FROM t', cast(turn as string), ' WHERE x = 1; fine')
 WHEN 4 THEN concat('DELETE FROM t', cast(turn as string), ';')
 WHEN 5 THEN concat('The SQL query is: drop table t', cast(turn as string))
 ELSE text END"""


def sim(template: str, key: str) -> str:
    return template.replace("{k}", key)


# Sampling

SEED = "42"


def prop_sql(view: str, keys: str, target: int, least: int = 1) -> str:
    order = ", ".join(f"{k} NULLS FIRST" for k in keys.split(", "))
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
q_c AS (SELECT {keys}, count(*) AS cnt FROM {view} GROUP BY {keys}),
q_a AS (SELECT *, CAST(least(greatest({least}, round_even(CAST(cnt * {target} AS DOUBLE) / sum(cnt) OVER (), 0)), cnt) AS BIGINT) AS a FROM q_c),
q_b AS (SELECT *, {target} - sum(a) OVER () AS need, cnt - a AS room, greatest(a - {least}, 0) AS slack FROM q_a),
q_d AS (SELECT *, coalesce(sum(room) OVER (ORDER BY cnt DESC, {order} {before}), 0) AS pr, coalesce(sum(slack) OVER (ORDER BY cnt, {order} {before}), 0) AS ps FROM q_b),
quotas AS (SELECT {keys}, cnt, CAST(CASE WHEN need > 0 THEN a + least(greatest(need - pr, 0), room) WHEN need < 0 THEN a - least(greatest(-need - ps, 0), slack) ELSE a END AS BIGINT) AS quota FROM q_d)"""


def uniform_sql(view: str, key: str, target: int) -> str:
    return f"""
q_c AS (SELECT {key}, count(*) AS cnt FROM {view} GROUP BY {key}),
q_a AS (SELECT *, count(*) OVER () AS k, min(cnt) OVER () AS mn, row_number() OVER (ORDER BY cnt DESC, {key} NULLS FIRST) AS r FROM q_c),
quotas AS (SELECT {key}, cnt, CAST(CASE WHEN {target} // k > mn THEN mn ELSE {target} // k + CASE WHEN r <= {target} % k AND {target} // k < cnt THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM q_a)"""


def two_level_sql(view: str, level: str, db: str, target: int) -> str:
    shared = lambda name, src, goal: f"""
{name}_0 AS (SELECT *, {goal} AS goal, round_even(ratio * {goal}, 0) AS t0 FROM {src}),
{name} AS (SELECT * EXCLUDE (t0, goal), CAST(t0 + CASE WHEN is_first THEN goal - sum(t0) OVER () ELSE 0 END AS BIGINT) AS t FROM {name}_0)"""  # noqa: E731
    return f"""
q_c AS (SELECT {level}, {db}, count(*) AS cnt FROM {view} GROUP BY ALL),
q_l AS (SELECT {level}, CAST(sum(cnt) AS BIGINT) AS n, count(*) AS dbs, min(cnt) AS mn FROM q_c GROUP BY {level}),
q_r AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER () AS ratio, row_number() OVER (ORDER BY n DESC, {level} NULLS FIRST) = 1 AS is_first FROM q_l),
{shared("q_1", "q_r", f"CAST({target} AS DOUBLE)")},
q_f AS (SELECT * EXCLUDE (t), least(CAST({target} AS DOUBLE), coalesce(min(CASE WHEN CAST(t AS DOUBLE) / dbs > mn THEN floor(mn * dbs / ratio) END) OVER (), {target})) AS feasible FROM q_1),
{shared("q_2", "q_f", "feasible")},
q_j AS (SELECT q_c.*, t, dbs, row_number() OVER (PARTITION BY q_c.{level} ORDER BY md5(concat_ws(':', '{SEED}', coalesce(q_c.{level}, ''), coalesce(q_c.{db}, ''))), q_c.{db} NULLS FIRST) AS r FROM q_c JOIN q_2 ON q_c.{level} IS NOT DISTINCT FROM q_2.{level}),
quotas AS (SELECT {level}, {db}, cnt, CAST(least(t // dbs + CASE WHEN r <= t % dbs THEN 1 ELSE 0 END, cnt) AS BIGINT) AS quota FROM q_j)"""


def member_sql(view: str, keys: str, key: str) -> str:
    on = " AND ".join(f"m.{k} IS NOT DISTINCT FROM quotas.{k}" for k in keys.split(", "))
    return f"""
m AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5(concat_ws(':', '{SEED}', coalesce(CAST({key} AS VARCHAR), ''))), {key}) AS rn FROM {view}),
chosen AS (SELECT m.* EXCLUDE (rn) FROM m JOIN quotas ON {on} WHERE rn <= quota)"""


def docs_quota(kind: str, docs: DataFrame) -> tuple[DataFrame, list[str]]:
    if kind == "proportional":
        return sampling.proportional_quota(sampling.strata(docs, ["source", "lang"]), ["source", "lang"], 200), ["source", "lang"]
    if kind == "uniform":
        return sampling.uniform_quota(sampling.strata(docs, ["source"]), ["source"], 333), ["source"]
    return sampling.two_level_quota(sampling.strata(docs, ["lang", "source"]), "lang", "source", 150), ["lang", "source"]


KINDS = {
    "proportional": (prop_sql("documents", "source, lang", 200), "source, lang"),
    "uniform": (uniform_sql("documents", "source", 333), "source"),
    "two_level": (two_level_sql("documents", "lang", "source", 150), "lang, source"),
}
for _kind, (_sql, _keys) in KINDS.items():
    QUERIES[f"quota_{_kind}"] = lambda spark, d, k=_kind: plain(docs_quota(k, table(spark, d, "documents"))[0])
    ORACLES[f"quota_{_kind}"] = f"WITH {_sql} SELECT * FROM quotas"

    def _sample(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        docs = table(spark, d, "documents").select("doc_id", "source", "lang")
        quotas, by = docs_quota(kind, docs)
        return plain(sampling.quota_sample(docs, quotas, by, "doc_id", SEED))

    QUERIES[f"sample_{_kind}"] = _sample
    ORACLES[f"sample_{_kind}"] = f"WITH {_sql}, {member_sql('documents', _keys, 'doc_id')} SELECT doc_id, source, lang FROM chosen"


@query("split_train_test", "SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))), doc_id) <= ceil(round(0.2 * count(*) OVER (), 9)) AS is_test FROM (SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels)")
def _split(spark, d):
    return sampling.split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query(
    "split_stratified",
    """WITH c AS (SELECT quality, count(*) AS cnt, CAST(ceil(round(0.25 * sum(count(*)) OVER (), 9)) AS BIGINT) AS goal, CAST(sum(count(*)) OVER () AS BIGINT) AS n FROM labels GROUP BY quality),
f AS (SELECT *, (goal * cnt) // n AS fl, row_number() OVER (ORDER BY (goal * cnt) % n DESC, quality NULLS FIRST) AS r, goal - sum((goal * cnt) // n) OVER () AS open_seats FROM c),
m AS (SELECT l.doc_id, l.quality, row_number() OVER (PARTITION BY l.quality ORDER BY md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))), doc_id) <= fl + CASE WHEN r <= open_seats THEN 1 ELSE 0 END AS is_test FROM labels l JOIN f ON l.quality IS NOT DISTINCT FROM f.quality)
SELECT doc_id, CAST(quality AS BIGINT) AS quality, is_test FROM m""",
)
def _split_stratified(spark, d):
    return sampling.split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", 0.25, ["quality"])


@query(
    "quota_nations",
    f"WITH {prop_sql('customer', 'c_nationkey', 200, 3)} SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, cnt, quota FROM quotas",
)
def _quota_nations(spark, d):
    return sampling.proportional_quota(sampling.strata(table(spark, d, "customer"), ["c_nationkey"]), ["c_nationkey"], 200, 3)


_SAMPLED = f"{KINDS['proportional'][0]}, {member_sql('documents', 'source, lang', 'doc_id')}"


@query(
    "strat_report",
    f"""WITH {_SAMPLED},
a AS (SELECT source, count(*) AS original FROM documents GROUP BY source), b AS (SELECT source, count(*) AS selected FROM chosen GROUP BY source),
j AS (SELECT a.source, original, coalesce(selected, 0) AS selected FROM a LEFT JOIN b ON a.source IS NOT DISTINCT FROM b.source),
p AS (SELECT *, 100.0 * original / sum(original) OVER () AS po, 100.0 * selected / sum(selected) OVER () AS ps FROM j)
SELECT source, original, selected, round(CAST(po AS DOUBLE), 6) AS original_pct, round(CAST(ps AS DOUBLE), 6) AS selected_pct, round(CAST(abs(po - ps) AS DOUBLE), 6) AS deviation FROM p""",
)
def _report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    quotas, by = docs_quota("proportional", docs)
    return sampling.sample_report(docs, sampling.quota_sample(docs, quotas, by, "doc_id", SEED), "source")


@query(
    "distribution_compare",
    f"""WITH {_SAMPLED},
l AS (SELECT 'lang' AS variable, lang AS value, 1 AS o, 0 AS s FROM documents UNION ALL SELECT 'lang', lang, 0, 1 FROM chosen
UNION ALL SELECT 'source', source, 1, 0 FROM documents UNION ALL SELECT 'source', source, 0, 1 FROM chosen),
n AS (SELECT variable, value, CAST(sum(o) AS DOUBLE) AS o, CAST(sum(s) AS DOUBLE) AS s FROM l GROUP BY ALL)
SELECT variable, value, round(o / sum(o) OVER (PARTITION BY variable), 6) AS original, round(s / sum(s) OVER (PARTITION BY variable), 6) AS subset FROM n""",
)
def _compare(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    quotas, by = docs_quota("proportional", docs)
    return sampling.compare_distributions(docs, sampling.quota_sample(docs, quotas, by, "doc_id", SEED), ["lang", "source"])


@query("referenced_schemas", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def _referenced(spark, d):
    named = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"))
    return sampling.referenced(table(spark, d, "nation"), named, "n_nationkey").select("n_nationkey", "n_name")


# SQL text


def count_of(pattern: str, text: str = "s") -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


_strip = "list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(s, '(?i)\\bFROM\\s+([^\\s,]+)', 1), regexp_extract_all(s, '(?i)\\bJOIN\\s+([^\\s]+)', 1)), lambda t: trim(t, '`\"''[]'))))"
_flat = "trim(regexp_extract(s, '(?is)SELECT\\s+(.*?)\\s+FROM', 1))"
_nested = _flat
for _ in range(6):
    _nested = f"regexp_replace({_nested}, '\\([^()]*\\)', '', 'g')"
_where = r"regexp_extract(s, '(?is)WHERE\s+(.*?)(?:GROUP BY|ORDER BY|LIMIT|HAVING|$)', 1)"
_clauses = "list_filter([" + ", ".join(f"CASE WHEN contains(upper(s), '{c}') THEN '{c}' END" for c in sqltext.CLAUSES) + "], lambda c: c IS NOT NULL)"
_aggs = "list_filter([" + ", ".join(f"CASE WHEN {count_of(rf'(?i)\b{a}\s*\(')} > 0 THEN '{a}' END" for a in sqltext.AGGREGATES) + "], lambda c: c IS NOT NULL)"


def analysis_sql(source: str) -> str:
    """A CTE ``an`` over ``source`` (k, s)."""
    return f"""src AS ({source}), an AS (SELECT k, s, length(s) AS char_length, CAST(len({_strip}) AS BIGINT) AS tables_count, array_to_string({_strip}, ',') AS tables,
{count_of("JOIN", "upper(s)")} AS join_count,
CASE WHEN regexp_matches(s, '(?is)WHERE\\s+') THEN {count_of(" AND ", f"upper({_where})")} + {count_of(" OR ", f"upper({_where})")} + 1 ELSE 0 END AS where_conditions,
greatest({count_of("SELECT", "upper(s)")} - 1, 0) AS subquery_count, CAST(len({_clauses}) AS BIGINT) AS clauses_count, array_to_string({_clauses}, ',') AS clause_types,
{" + ".join(count_of(rf"(?i)\b{a}\s*\(") for a in sqltext.AGGREGATES)} AS aggregation_function_count, array_to_string({_aggs}, ',') AS aggregation_functions,
CASE WHEN {_flat} = '' THEN 0 WHEN {_flat} = '*' THEN 1 ELSE len(regexp_extract_all(regexp_replace({_nested}, ',\\s*$', ''), ',')) + 1 END AS select_columns FROM src)"""


ANALYSIS = ["char_length", "tables_count", "tables", "join_count", "where_conditions", "subquery_count", "clauses_count", "clause_types", "aggregation_function_count", "aggregation_functions", "select_columns"]
_ORDERS = f"SELECT o_orderkey AS k, {sim(SIM_SQL, 'o_orderkey')} AS s FROM orders"
_as_long = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if not c.endswith(("tables", "types", "functions")) else c for c in ANALYSIS)


def statements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr(sim(SIM_SQL, "o_orderkey")).alias("s"))


@query("sql_analysis", f"WITH {analysis_sql(_ORDERS)} SELECT k, {_as_long} FROM an")
def _analysis(spark, d):
    return statements(spark, d).select("k", sqltext.analyze_sql(F.col("s")).alias("a")).select("k", *[F.col(f"a.{c}").alias(c) for c in ANALYSIS])


_tokens = count_of(sqltext.TOKEN)
_level = f"CASE WHEN {_tokens} > 160 THEN 'challenging' WHEN {_tokens} > 80 THEN 'moderate' ELSE 'simple' END"


@query("sql_difficulty", f"SELECT k, CAST({_tokens} AS BIGINT) AS tokens, {_level} AS difficulty FROM ({_ORDERS})")
def _difficulty(spark, d):
    return statements(spark, d).select("k", sqltext.token_count(F.col("s")).alias("tokens"), sqltext.difficulty(F.col("s")).alias("difficulty"))


_type = """CASE WHEN subquery_count > 0 AND contains(clause_types, 'GROUP BY') THEN 'nested_with_groupby' WHEN subquery_count > 0 THEN 'nested'
WHEN contains(clause_types, 'GROUP BY') AND contains(clause_types, 'HAVING') THEN 'groupby_having' WHEN contains(clause_types, 'GROUP BY') THEN 'groupby'
WHEN join_count > 0 THEN 'join' WHEN contains(clause_types, 'ORDER BY') THEN 'orderby' ELSE 'simple' END"""


@query(
    "sql_strat_variable",
    f"""WITH {analysis_sql(_ORDERS)}, z AS (SELECT *, nullif(k % 12, 11) AS n FROM an) SELECT k, {_type} AS query_type,
concat_ws('_', {_type}, CASE WHEN n IS NULL THEN 'unknown' WHEN n <= 3 THEN 'small' WHEN n <= 7 THEN 'medium' ELSE 'large' END,
CASE WHEN aggregation_functions <> '' THEN concat('agg_', string_split(aggregation_functions, ',')[1]) END, CASE WHEN length(s) < 30 THEN 'short' WHEN length(s) < 70 THEN 'medium' ELSE 'long' END) AS strat_var FROM z""",
)
def _strat_variable(spark, d):
    a = sqltext.analyze_sql(F.col("s"))
    return statements(spark, d).select("k", sqltext.query_type(a).alias("query_type"), sqltext.strat_variable(a, F.nullif(F.col("k") % 12, F.lit(11)), F.col("s")).alias("strat_var"))


def norm_sql(s: str) -> str:
    first = f"regexp_extract({s}, {q(r'''(?s)^\s*((?:'[^']*'|"[^"]*"|[^;'"]|['"])*)''')}, 1)"
    return f"trim(array_to_string(list_transform(regexp_extract_all({first}, {q(sqltext.PIECE)}), lambda p: CASE WHEN regexp_matches(p, '^\\s+$') THEN ' ' WHEN list_contains({listed(sqltext.KEYWORDS)}, upper(p)) THEN upper(p) ELSE p END), ''))"


@query("sql_normalize", f"SELECT k, {norm_sql('s')} AS normal FROM ({_ORDERS})")
def _normalize(spark, d):
    return statements(spark, d).select("k", sqltext.normalize_sql(F.col("s")).alias("normal"))


_CHANGED = "CASE k % 4 WHEN 0 THEN replace(lower(s), ' ', '  ') WHEN 1 THEN replace(s, 'SELECT', 'select') WHEN 2 THEN concat(s, ' ;') ELSE s END"


@query("sql_exact_match", f"SELECT k, {norm_sql('s')} = {norm_sql('p')} AS exact_match FROM (SELECT *, {_CHANGED} AS p FROM ({_ORDERS}))")
def _exact(spark, d):
    return statements(spark, d).withColumn("p", F.expr(_CHANGED)).select("k", sqltext.exact_match(F.col("s"), F.col("p")).alias("exact_match"))


_verb = "(?:" + "|".join(sqltext.VERBS) + ")"
_strip_sql = lambda x: f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"
_hit = lambda p: _strip_sql(f"regexp_extract(t, {q(p)}, 1)")
_blank = "translate(regexp_extract(t, '(?s)(\\{.*\"sql\".*\\})', 1), concat(chr(10), chr(13), chr(9)), '   ')"


@query(
    "sql_extract_from_text",
    f"""WITH r AS (SELECT conv_id, turn, regexp_replace({SIM_REPLY}, '(?s)<think>.*?</think>', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, coalesce(CASE WHEN json_valid({_blank}) THEN {_strip_sql(f"json_extract_string({_blank}, '$.sql')")} END,
{_hit(r"(?is)```sql\s*(.*?)```")}, {_hit(rf"(?is)```[a-z]*\s*([^`]*\b{_verb}\b[^`]*)```")}, {_hit(r"(?is)(\bSELECT\b.*?\bFROM\b.*?(?:;|$))")},
{_hit(r"(?is)(\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE)\b.*?(?:;|$))")}, {_hit(rf"(?is)the sql query is:?\s*(.*\b{_verb}\b.*)")}, '') AS sql FROM r""",
)
def _extract(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sqltext.extract_sql(F.expr(SIM_REPLY)).alias("sql"))


# Questions

_CUSTOMERS = f"SELECT c_custkey AS k, {sim(SIM_QUESTION, 'c_custkey')} AS t FROM customer"
_words = f"regexp_extract_all(t, {q('(' + nl.TOKEN + ')')}, 1)"
_among = lambda values: f"list_filter({_words}, lambda w: list_contains({listed(values)}, lower(w)))"
_numbers = f"list_filter({_words}, lambda w: regexp_matches(w, '^[0-9]') OR list_contains({listed(nl.NUMBER_WORDS)}, lower(w)))"
_negated = f"list_filter({_words}, lambda w: list_contains({listed(nl.NEGATIONS)}, lower(w)) OR ends_with(lower(w), 'n''t'))"
_entity_texts = "list_concat(" + ", ".join(f"regexp_extract_all(t, {q('(' + p + ')')}, 1)" for p in nl.ENTITY_PATTERNS.values()) + ")"
_entity_types = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {q(p)}) THEN '{label}' END" for label, p in nl.ENTITY_PATTERNS.items()) + "], lambda x: x IS NOT NULL)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "customer").select("c_custkey")).select(F.col("c_custkey").alias("k"), F.expr(sim(SIM_QUESTION, "c_custkey")).alias("t"))


@query(
    "question_analysis",
    f"""SELECT k, length(t) AS char_length, CAST(len({_words}) AS BIGINT) AS word_length, array_to_string({_entity_texts}, ',') AS entities, array_to_string({_entity_types}, ',') AS entity_types,
array_to_string({_numbers}, ',') AS numbers, len({_negated}) > 0 AS has_negation, array_to_string({_negated}, ',') AS negation_words,
array_to_string({_among(nl.COMPARATIVES)}, ',') AS comparatives, len({_among(nl.SUPERLATIVES)}) > 0 AS has_superlatives FROM ({_CUSTOMERS})""",
)
def _question(spark, d):
    a = questions(spark, d).select("k", nl.analyze_question(F.col("t")).alias("a"))
    return a.select("k", "a.char_length", "a.word_length", F.col("a.entities.text").alias("entities"), "a.entity_types", "a.numbers", "a.has_negation", "a.negation_words", "a.comparatives", "a.has_superlatives")


NAMES = ["Orders", "customer", "Segments", "country", "name"]
_terms = f"list_distinct(list_filter(list_transform({_words}, lambda w: lower(w)), lambda w: regexp_matches(w, '^[a-z]+$') AND NOT list_contains({listed(nl.STOP_WORDS)}, w)))"
_lemma = lambda a: f"list_transform({a}, lambda w: CASE WHEN regexp_matches(lower(w), '[a-z]{{2}}ies$') THEN regexp_replace(lower(w), 'ies$', 'y') WHEN regexp_matches(lower(w), '[a-z]{{2}}[^s]s$') THEN regexp_replace(lower(w), 's$', '') ELSE lower(w) END)"
_lowered = listed([n.lower() for n in NAMES])


@query(
    "schema_overlap",
    f"SELECT k, CAST(len(list_intersect({_lowered}, {_terms})) AS BIGINT) AS overlap, CAST(len(list_intersect({_lemma(_lowered)}, list_distinct({_lemma(_terms)}))) AS BIGINT) AS overlap_lemma FROM ({_CUSTOMERS})",
)
def _overlap(spark, d):
    exact, by_lemma = nl.overlap(F.col("t"), F.array(*map(F.lit, NAMES)))
    return questions(spark, d).select("k", exact.alias("overlap"), by_lemma.alias("overlap_lemma"))


@query("question_uid", "SELECT doc_id, concat('docs_', doc_id, '_g_', substr(translate(to_base64(unhex(sha256(concat_ws('_', 'docs', text, source, lang)))), '+/', '-_'), 1, 8)) AS question_uid FROM documents")
def _uid(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", standardize.question_uid(F.lit("docs"), F.col("doc_id").cast("string"), F.col("text"), F.col("source"), F.col("lang")).alias("question_uid"))


@query(
    "question_vectors",
    f"""WITH w AS MATERIALIZED (SELECT k, word, count(*) AS times FROM (SELECT k, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS word FROM ({_CUSTOMERS})) GROUP BY ALL),
names AS MATERIALIZED (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w)), {duck.xxh64_sql("names", "hashed")},
v AS (SELECT k, h & 63 AS place, CAST(sum(times) AS DOUBLE) AS n FROM w JOIN hashed USING (word) GROUP BY ALL),
c AS (SELECT k, sum(n) FILTER (place % 2 = 0) / (sqrt(sum(n * n)) * sqrt(32)) AS a, sum(n) FILTER (place % 3 = 0) / (sqrt(sum(n * n)) * sqrt(22)) AS b FROM v GROUP BY k)
SELECT k, coalesce((coalesce(a, 0) + coalesce(b, 0)) / 2, 0) AS avg_similarity, coalesce(greatest(a, b), 0) AS max_similarity FROM ({_CUSTOMERS}) LEFT JOIN c USING (k)""",
)
def _vectors(spark, d):
    rows = questions(spark, d).withColumn("v", hashed_embedding("t"))
    every = lambda s: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (k % s == 0).cast("float"))
    names = F.array(every(2), every(3))
    return rows.select("k", nl.similarity_stats(F.col("v"), names).alias("s")).select("k", "s.*")


# Schemas

# columns and keys come and go with the nation's number
_DDL = """concat('CREATE TABLE IF NOT EXISTS db."', n_name, '" ("the id" NUMBER(', cast(10 + n_nationkey as string), ',0) NOT NULL', CASE WHEN n_nationkey % 4 < 3 THEN ' PRIMARY KEY' ELSE '' END,
 CASE WHEN n_nationkey % 3 > 0 THEN concat(', name VARCHAR(', cast(n_nationkey as string), ') DEFAULT ', chr(39), 'a,b', chr(39)) ELSE '' END, ', up int REFERENCES region(r_', cast(n_regionkey as string), ')',
 CASE WHEN n_nationkey % 5 > 1 THEN concat(', FOREIGN KEY (up) REFERENCES s.other_', cast(n_nationkey as string), ' (x), UNIQUE (up)') ELSE '' END, ')')"""
_COLUMNS = """SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY place) - 1 AS position FROM (
 SELECT n_nationkey, n_regionkey, n_name, 1 AS place, 'the id' AS name, concat('NUMBER(', 10 + n_nationkey, ',0)') AS type, n_nationkey % 4 < 3 AS is_pk FROM nation UNION ALL
 SELECT n_nationkey, n_regionkey, n_name, 2, 'name', concat('VARCHAR(', n_nationkey, ')'), false FROM nation WHERE n_nationkey % 3 > 0 UNION ALL
 SELECT n_nationkey, n_regionkey, n_name, 3, 'up', 'INT', false FROM nation)"""
_FOREIGN_KEYS = """SELECT n_nationkey, n_regionkey, n_name, 'up' AS "column", NULL AS references_schema, 'region' AS references_table, concat('r_', n_regionkey) AS references_column FROM nation UNION ALL
 SELECT n_nationkey, n_regionkey, n_name, 'up', 's', concat('other_', n_nationkey), 'x' FROM nation WHERE n_nationkey % 5 > 1"""


def schema_counts_sql(owners: str, key: str) -> str:
    """Counts of the tables that ``owners`` (key, n_nationkey) gives each schema."""
    return f"""SELECT {key}, count(*) AS tables_count, CAST(sum(c) AS BIGINT) AS columns_count, CAST(sum(p) AS BIGINT) AS primary_keys_count, CAST(sum(f) AS BIGINT) AS foreign_keys_count
FROM ({owners}) o JOIN (SELECT n_nationkey, count(*) AS c, count(*) FILTER (is_pk) AS p FROM ({_COLUMNS}) GROUP BY n_nationkey) USING (n_nationkey)
JOIN (SELECT n_nationkey, count(*) AS f FROM ({_FOREIGN_KEYS}) GROUP BY n_nationkey) USING (n_nationkey) GROUP BY {key}"""


def parsed_nations(spark: SparkSession, d: str) -> DataFrame:
    return ddl.parse_tables(table(spark, d, "nation").withColumn("DDL", F.expr(_DDL)))


# Features


def plain_instances(spark: SparkSession, d: str) -> DataFrame:
    raw = spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")).select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("db_id"), F.expr(sim(SIM_QUESTION, "c_custkey")).alias("question"), F.expr(sim(SIM_SQL, "c_custkey")).alias("sql"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END").alias("evidence"),
    )
    return standardize.standardize(raw, "sim")


def instances(spark: SparkSession, d: str) -> DataFrame:
    return enrich(plain_instances(spark, d))


_INST = f"SELECT c_custkey AS k, {sim(SIM_SQL, 'c_custkey')} AS s, {sim(SIM_QUESTION, 'c_custkey')} AS t, c_mktsegment AS db_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS evidence FROM customer"
_Q_COLS = f"""'sim' AS dataset, k AS id, db_id, {_level} AS difficulty, length(t) AS char_length, CAST(len({_words}) AS BIGINT) AS word_length, CAST(len({_numbers}) AS BIGINT) AS numbers_count,
CAST(len({_negated}) > 0 AS BIGINT) AS has_negation, CAST(list_contains({_entity_types}, 'DATE') AS BIGINT) AS entity_date, CAST(list_contains({_entity_types}, 'MONEY') AS BIGINT) AS entity_money,
CAST(evidence <> '' AS BIGINT) AS has_evidence, length(evidence) AS evidence_length"""
Q_NAMES = ["dataset", "id", "db_id", "difficulty", "char_length", "word_length", "numbers_count", "has_negation", "entity_date", "entity_money", "has_evidence", "evidence_length"]
S_NAMES = ["sql_char_length", "tables_count", "join_count", "where_conditions", "subquery_count", "has_group_by", "has_limit", "uses_count", "uses_max"]
_S_COLS = """CAST(char_length AS BIGINT) AS sql_char_length, tables_count, CAST(join_count AS BIGINT) AS join_count, CAST(where_conditions AS BIGINT) AS where_conditions, CAST(subquery_count AS BIGINT) AS subquery_count,
CAST(contains(clause_types, 'GROUP BY') AS BIGINT) AS has_group_by, CAST(contains(clause_types, 'LIMIT') AS BIGINT) AS has_limit, CAST(contains(aggregation_functions, 'COUNT') AS BIGINT) AS uses_count, CAST(contains(aggregation_functions, 'MAX') AS BIGINT) AS uses_max"""


@query("features_question", f"SELECT {_Q_COLS} FROM ({_INST})")
def _features_question(spark, d):
    return features.question_features(instances(spark, d)).select(Q_NAMES)


@query("features_sql", f"WITH {analysis_sql(f'SELECT k, s, db_id FROM ({_INST})')}, e AS (SELECT an.*, src.db_id FROM an JOIN src USING (k)) SELECT 'sim' AS dataset, k AS id, db_id, {_S_COLS} FROM e")
def _features_sql(spark, d):
    return features.sql_features(instances(spark, d)).select(*features.KEYS, *S_NAMES)


@query(
    "features_combined",
    f"""WITH {analysis_sql(f'SELECT k, s FROM ({_INST})')}, qf AS (SELECT {_Q_COLS} FROM ({_INST})), sf AS (SELECT k AS id, {_S_COLS} FROM an), n AS ({schema_counts_sql("SELECT DISTINCT c_mktsegment AS db_id, c_nationkey AS n_nationkey FROM customer", "db_id")})
SELECT qf.*, sf.* EXCLUDE (id), n.tables_count AS schema_tables, n.columns_count AS schema_columns, n.primary_keys_count AS schema_primary_keys, n.foreign_keys_count AS schema_foreign_keys FROM qf LEFT JOIN sf ON qf.id = sf.id LEFT JOIN n ON qf.db_id IS NOT DISTINCT FROM n.db_id""",
)
def _features_combined(spark, d):
    rows = instances(spark, d)
    # a segment's schema has a table for each nation of its customers
    owned = table(spark, d, "customer").select(F.lit("sim").alias("dataset"), F.col("c_mktsegment").alias("db_id"), F.col("c_nationkey").alias("n_nationkey")).distinct()
    schemas = ddl.analyze_schema(owned.join(parsed_nations(spark, d), "n_nationkey"), ["dataset", "db_id"])
    return features.instance_features(rows, features.schema_features(schemas)).select(*Q_NAMES, *S_NAMES, *[f"schema_{c}" for c in ("tables", "columns", "primary_keys", "foreign_keys")])


@query("features_dataset", "SELECT 'bird' AS dataset, doc_id AS id, source AS db_id, CAST(lang = 'en' AS BIGINT) AS has_evidence, CASE WHEN lang = 'en' THEN length(source) ELSE 0 END AS evidence_length FROM documents WHERE source < 'src5'")
def _features_dataset(spark, d):
    docs = table(spark, d, "documents").select(F.expr("CASE WHEN source < 'src5' THEN 'bird' ELSE 'spider' END").alias("dataset"), F.col("doc_id").alias("id"), F.col("source").alias("db_id"), F.expr("CASE WHEN lang = 'en' THEN source ELSE '' END").alias("evidence"))
    return features.dataset_features(docs, "BIRD")


@query("entity_onehot", "SELECT event_id, " + ", ".join(f"CAST(event_type = '{t}' AS BIGINT) AS type_{t}" for t in ("view", "click", "purchase")) + " FROM events")
def _onehot(spark, d):
    return table(spark, d, "events").select("event_id", *features.one_hot(F.array("event_type"), ["view", "click", "purchase"], "type"))


# Profiles


@query(
    "corpus_profile",
    """SELECT count(*) AS total_examples, count(DISTINCT source) AS unique_dbs, round(avg(n_chars), 6) AS avg_n_chars, round(stddev_pop(n_chars), 6) AS std_n_chars, round(avg(CAST(lang = 'en' AS INT)) * 100, 6) AS pct_is_en,
min(n_chars) AS min_n_chars, max(n_chars) AS max_n_chars, round(avg(n_chars), 6) AS mean_n_chars FROM documents""",
)
def _profile(spark, d):
    return profile.profile(table(spark, d, "documents").withColumn("is_en", F.col("lang") == "en"), ["n_chars"], ["is_en"], ["n_chars"], "source")


@query("profile_by_difficulty", "SELECT lang, count(*) AS total_examples, round(avg(n_chars), 6) AS avg_n_chars, round(stddev_pop(n_chars), 6) AS std_n_chars FROM documents GROUP BY lang")
def _profile_by(spark, d):
    return profile.profile(table(spark, d, "documents"), ["n_chars"], by=["lang"])


_BY_LENGTH = "CASE WHEN n_chars > 20000 THEN 'challenging' WHEN n_chars > 5000 THEN 'moderate' ELSE 'simple' END"
_GRID = f"""c AS (SELECT concat(source, '-', lang) AS dataset, {_BY_LENGTH} AS difficulty, count(*) AS cnt FROM documents GROUP BY ALL)"""


def sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.expr("concat(source, '-', lang)").alias("dataset"), F.expr(_BY_LENGTH).alias("difficulty"))


@query("difficulty_distribution", f"WITH {_GRID} SELECT *, round_even(100.0 * cnt / CAST(sum(cnt) OVER (PARTITION BY dataset) AS DOUBLE), 2) AS percentage FROM c")
def _distribution(spark, d):
    return profile.difficulty_distribution(sized(spark, d), "dataset", "difficulty")


@query(
    "difficulty_grid",
    f"""WITH {_GRID}, g AS (SELECT a.dataset, b.difficulty, coalesce(c.cnt, 0) AS cnt FROM (SELECT DISTINCT dataset FROM c) a CROSS JOIN (SELECT DISTINCT difficulty FROM c) b LEFT JOIN c ON c.dataset = a.dataset AND c.difficulty = b.difficulty)
SELECT *, round_even(100.0 * cnt / CAST(sum(cnt) OVER (PARTITION BY dataset) AS DOUBLE), 2) AS percentage FROM g""",
)
def _grid(spark, d):
    return profile.difficulty_distribution(sized(spark, d), "dataset", "difficulty", grid=True)


@query("top_dbs", "SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS cnt FROM events GROUP BY user_id ORDER BY cnt DESC, value LIMIT 10")
def _top(spark, d):
    return profile.top_values(table(spark, d, "events").withColumn("user", F.col("user_id").cast("string")), "user")


@query("histogram_quantity", "SELECT CAST(l_quantity AS DOUBLE) AS value, count(*) AS cnt FROM lineitem GROUP BY l_quantity")
def _histogram(spark, d):
    return profile.histogram(table(spark, d, "lineitem"), "l_quantity")


@query("clause_occurrence", f"WITH {analysis_sql(_ORDERS)} SELECT value, count(*) AS cnt FROM (SELECT unnest(string_split(clause_types, ',')) AS value FROM an WHERE clause_types <> '') GROUP BY value")
def _occurrence(spark, d):
    return profile.occurrence(statements(spark, d).select(sqltext.analyze_sql(F.col("s"))["clause_types"].alias("c")), "c")


@query("join_multiplicity", f"WITH {analysis_sql(_ORDERS)} SELECT round(avg(CAST(join_count = 0 AS INT)) * 100, 6) AS pct_none, round(avg(CAST(join_count > 0 AS INT)) * 100, 6) AS pct_some, round(avg(CAST(join_count > 1 AS INT)) * 100, 6) AS pct_multi FROM an")
def _multiplicity(spark, d):
    return profile.multiplicity(statements(spark, d).select(sqltext.analyze_sql(F.col("s"))["join_count"].alias("join_count")), "join_count")


@query("combine_profiles", "SELECT difficulty, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT lang AS difficulty, count(*) AS cnt FROM documents GROUP BY lang UNION ALL SELECT role, count(*) FROM conversations GROUP BY role UNION ALL SELECT lang, count(*) FROM documents GROUP BY lang) GROUP BY difficulty")
def _combine(spark, d):
    by = lambda name, c: table(spark, d, name).groupBy(F.col(c).alias("difficulty")).agg(F.count("*").alias("cnt"))
    return profile.combine([by("documents", "lang"), by("conversations", "role"), by("documents", "lang")])


@query("schema_group_sizes", "SELECT concat_ws('_', 'events', coalesce(event_type, 'unknown'), CAST(user_id AS VARCHAR)) AS schema_key, count(*) AS cnt FROM events GROUP BY ALL")
def _groups(spark, d):
    return profile.group_sizes(table(spark, d, "events"), [F.lit("events"), F.col("event_type"), F.col("user_id")])


@query(
    "schema_group_describe",
    """SELECT count(*) AS count, round(avg(cnt), 6) AS mean, round(stddev_samp(cnt), 6) AS std, CAST(min(cnt) AS DOUBLE) AS min, CAST(quantile_cont(cnt, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont(cnt, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(cnt, 0.75) AS DOUBLE) AS p75, CAST(max(cnt) AS DOUBLE) AS max
FROM (SELECT count(*) AS cnt FROM conversations GROUP BY conv_id)""",
)
def _describe(spark, d):
    return profile.describe(profile.group_sizes(table(spark, d, "conversations"), [F.col("conv_id")]), "cnt")


@query("latest_per_key", "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _latest(spark, d):
    return profile.first_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type", "value")


@query("first_per_key", "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _first(spark, d):
    return profile.first_per_key(table(spark, d, "documents"), ["source", "lang"], [F.col("doc_id")]).select("doc_id", "source", "lang")


def logs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = table(spark, d, "conversations").select(
        F.col("role").alias("model"), F.concat(F.lit("d"), F.col("conv_id") % 3).alias("dataset"), F.concat(F.lit("s"), F.col("conv_id") % 17).alias("schema_key"), F.length("text").alias("response_length"),
        (F.col("turn") % 4 / 4).alias("success_rate"), (F.col("turn") % 3 / 2).alias("accuracy"), F.col("turn").alias("questions"), (F.col("conv_id") % 9).alias("tables"),
    )
    return profile.log_analysis(rows)


@query("log_by_model", "SELECT role AS model, count(*) AS n, round(avg(length(text)), 6) AS mean_response_length, round(avg((turn % 4) / 4), 6) AS mean_success_rate, round(avg((turn % 3) / 2), 6) AS mean_accuracy, CAST(sum(turn) AS BIGINT) AS questions FROM conversations GROUP BY role")
def _log_model(spark, d):
    return logs(spark, d)["by_model"]


@query("log_by_dataset", "SELECT concat('d', conv_id % 3) AS dataset, count(*) AS n, round(avg(conv_id % 9), 6) AS mean_tables FROM conversations GROUP BY 1")
def _log_dataset(spark, d):
    return logs(spark, d)["by_dataset"]


@query("log_top_schemas", "SELECT concat('s', conv_id % 17) AS value, count(*) AS cnt FROM conversations GROUP BY 1 ORDER BY cnt DESC, value LIMIT 5")
def _log_schemas(spark, d):
    return logs(spark, d)["top_schemas"]


_RATES = "SELECT lang AS model, avg(n_chars) AS accuracy FROM documents WHERE source {} 'src10' GROUP BY lang"


@query("compare_with_baseline", f"SELECT o.model, round(o.accuracy, 6) AS accuracy_optimized, round(b.accuracy, 6) AS accuracy_baseline, round((o.accuracy - b.accuracy) / b.accuracy, 6) AS accuracy_gain FROM ({_RATES.format('<')}) o JOIN ({_RATES.format('>=')}) b ON o.model = b.model")
def _baseline(spark, d):
    docs = table(spark, d, "documents")
    rate = lambda rows: rows.groupBy(F.col("lang").alias("model")).agg(F.avg("n_chars").alias("accuracy"))
    return profile.compare_with_baseline(rate(docs.where("source < 'src10'")), rate(docs.where("source >= 'src10'")), ["accuracy"])


# Standardisation


@query("standardize_instances", f"SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS original_instance_id, 'sim' AS dataset, c_mktsegment AS db_id, {sim(SIM_QUESTION, 'c_custkey')} AS question, {sim(SIM_SQL, 'c_custkey')} AS sql, c_name AS evidence, 'unknown' AS difficulty FROM customer")
def _standardize(spark, d):
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_mktsegment").alias("db"), F.expr(sim(SIM_QUESTION, "c_custkey")).alias("instruction"), F.expr(sim(SIM_SQL, "c_custkey")).alias("SQL"), F.col("c_name").alias("external_knowledge"))
    return standardize.standardize(raw, "sim").select("id", "original_instance_id", "dataset", "db_id", "question", "sql", "evidence", "difficulty")


@query("choose_engine", "SELECT db, CASE min(o) WHEN 1 THEN 'sqlite' ELSE 'snowflake' END AS engine FROM (SELECT CAST(s_nationkey AS BIGINT) AS db, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS o FROM supplier) WHERE o IS NOT NULL GROUP BY db")
def _engine(spark, d):
    paths = table(spark, d, "supplier").select(F.col("s_nationkey").alias("db"), F.element_at(F.array(*map(F.lit, ["sqlite", "snowflake", "bigquery"])), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("engine"), F.array("s_name").alias("paths"))
    return standardize.choose_engine(paths, ["sqlite", "snowflake"]).select("db", "engine")


@query("rewrite_paths", "SELECT page_id, concat('out/', string_split(url, '/')[-1]) AS path FROM pages")
def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", standardize.rewrite_paths(F.array("url"), F.lit("out"))[0].alias("path"))


@query("model_name", "SELECT doc_id, CASE WHEN contains(n, '/') THEN string_split(n, '/')[2] ELSE n END AS model FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source ELSE concat('org/', source, '/v') END AS n FROM documents)")
def _model_name(spark, d):
    return table(spark, d, "documents").select("doc_id", standardize.model_name(F.expr("CASE doc_id % 3 WHEN 0 THEN source ELSE concat('org/', source, '/v') END")).alias("model"))


# Evaluation


_SETS = """o AS (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS k FROM orders), twice AS (SELECT * FROM o UNION ALL SELECT * FROM o),
part AS (SELECT * FROM o WHERE o_orderstatus = 'O'), nought AS (SELECT * FROM o WHERE o_custkey < 0)"""


def _same(gold: str, other: str, all_rows: str) -> str:
    return " AND ".join(f"NOT EXISTS (SELECT * FROM {a} EXCEPT {all_rows} SELECT * FROM {b})" for a, b in ((gold, other), (other, gold)))


@query(
    "result_set_equal",
    f"WITH {_SETS} " + " UNION ALL ".join(f"SELECT '{name}' AS pair, {_same(gold, other, '')} AS set_equal, {_same(gold, other, 'ALL')} AS bag_equal" for name, gold, other in (("same", "o", "o"), ("doubled", "o", "twice"), ("fewer", "o", "part"), ("empty", "nought", "nought"))),
)
def _results(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderkey")).alias("k"))
    pairs = {"same": orders.select(F.col("o_custkey").alias("x"), F.col("o_orderstatus").alias("y"), "k"), "doubled": orders.unionAll(orders), "fewer": orders.where("o_orderstatus = 'O'")}
    none = orders.where("o_custkey < 0")
    out = None
    for name, other in {**pairs, "empty": none}.items():
        gold = none if name == "empty" else orders
        row = evaluate.results_equal(gold, other).select(F.lit(name).alias("pair"), F.col("equal").alias("set_equal")).join(evaluate.results_equal(gold, other, bag=True).select(F.col("equal").alias("bag_equal")))
        out = row if out is None else out.unionAll(row)
    return out


@query("result_difference", "SELECT count(*) AS n FROM ((SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') UNION ALL (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'))")
def _difference(spark, d):
    o = table(spark, d, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderpriority")
    return evaluate.differing_rows(side("O"), side("F")).agg(F.count("*").alias("n"))


_PRED = f"""SELECT d.doc_id AS id, concat('m', d.doc_id % 3) AS model, {sim(SIM_SQL, 'd.doc_id')} AS sql, CASE WHEN d.doc_id % 5 = 0 THEN {sim(SIM_SQL, 'd.doc_id')} ELSE concat('select ', source) END AS generated_sql,
quality = 1 AS execution_correct, CASE WHEN toxic = 1 THEN 'boom' END AS execution_error, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.doc_id % 4 = 1 END AS judged, quality IS NOT NULL AS has_prediction
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id"""
_CASCADE = f"""p AS ({_PRED.format(documents="documents", labels="labels")}), e AS (SELECT *, {norm_sql("sql")} = {norm_sql("generated_sql")} AS exact_match FROM p),
c AS (SELECT *, CASE WHEN exact_match THEN true WHEN coalesce(execution_correct, false) THEN true WHEN coalesce(execution_error, '') <> '' THEN false ELSE coalesce(judged, false) END AS semantic_equivalent,
CASE WHEN exact_match THEN '{evaluate.EXACT}' WHEN coalesce(execution_correct, false) THEN '{evaluate.EXECUTED}' WHEN coalesce(execution_error, '') <> '' THEN concat('{evaluate.FAILED}', execution_error)
WHEN judged IS NULL THEN 'Could not determine semantic equivalence' WHEN judged THEN 'Judged equivalent' ELSE 'Judged different' END AS semantic_explanation FROM e)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PRED.format(documents="{documents}", labels="{labels}"), documents=table(spark, d, "documents"), labels=table(spark, d, "labels"))


@query("eval_cascade", f"WITH {_CASCADE} SELECT id, model, exact_match, semantic_equivalent, semantic_explanation FROM c")
def _cascade(spark, d):
    return evaluate.evaluate(predictions(spark, d)).select("id", "model", "exact_match", "semantic_equivalent", "semantic_explanation")


_rate = lambda c, name: f"coalesce(round(CAST(count(*) FILTER (has_prediction AND coalesce({c}, false)) AS DOUBLE) / nullif(count(*) FILTER (has_prediction), 0), 6), 0) AS {name}"


@query(
    "eval_metrics_by_model",
    f"""WITH {_CASCADE} SELECT model, count(*) AS num_evaluated, count(*) FILTER (has_prediction) AS num_with_prediction, round(CAST(count(*) FILTER (has_prediction) AS DOUBLE) / count(*), 6) AS prediction_rate,
{_rate("execution_correct", "execution_accuracy")}, {_rate("exact_match", "exact_match_accuracy")}, {_rate("semantic_equivalent", "semantic_equivalent_accuracy")} FROM c GROUP BY model""",
)
def _metrics(spark, d):
    return evaluate.metrics(evaluate.evaluate(predictions(spark, d)))


@query("missing_predictions", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _missing(spark, d):
    done = table(spark, d, "labels").withColumn("has_prediction", F.col("quality") == 1)
    return evaluate.missing_predictions(table(spark, d, "documents").select("doc_id"), done, ["doc_id"])


_JUDGE = """CASE conv_id % 6 WHEN 0 THEN '{"equivalent": true, "why": "x"}' WHEN 1 THEN '{"equivalent": "no"}' WHEN 2 THEN 'They are not equivalent.' WHEN 3 THEN 'Yes, the same' WHEN 4 THEN 'Different' ELSE text END"""
_jbody = "regexp_extract(t, '(?s)(\\{.*\"equivalent\".*\\})', 1)"


@query(
    "judge_verdict",
    f"""WITH r AS (SELECT conv_id, turn, {_JUDGE} AS t FROM conversations), s AS (SELECT *, CASE WHEN json_valid({_jbody}) THEN lower(json_extract_string({_jbody}, '$.equivalent')) END AS said FROM r)
SELECT conv_id, turn, CASE WHEN said IN ('true', 'yes') THEN true WHEN said IN ('false', 'no') THEN false WHEN regexp_matches(lower(t), '\\b(?:no|not|different|unequal|inequivalent)\\b') THEN false WHEN regexp_matches(lower(t), '\\b(?:yes|equivalent|same|equal)\\b') THEN true END AS verdict FROM s""",
)
def _judge(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", prompts.judge_verdict(F.expr(_JUDGE)).alias("verdict"))


# Retrieval and choice of models

_D2 = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NEIGHBOURS = f"""pairs AS (SELECT a.vec_id AS input_id, b.vec_id AS vec_id, {_D2} AS d2 FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0),
nb AS (SELECT *, 1 / (1 + d2) AS score, row_number() OVER (PARTITION BY input_id ORDER BY d2, vec_id) AS rank FROM pairs QUALIFY rank <= 10)"""
_OUTCOMES = "oc AS (SELECT vec_id, concat('m', m) AS model, CAST((label + vec_id % 7 + m) % 3 = 0 AS INT) AS success FROM embeddings CROSS JOIN range(3) t(m) WHERE (vec_id + m) % 11 <> 0)"
_VOTE = f"""{_NEIGHBOURS}, {_OUTCOMES}, tot AS (SELECT input_id, sum(score) AS total FROM nb GROUP BY input_id),
won AS (SELECT input_id, model, sum(score * success) AS won, sum(success) AS n FROM nb JOIN oc USING (vec_id) GROUP BY ALL),
vote AS (SELECT tot.input_id, md.model, CAST(coalesce(n, 0) AS BIGINT) AS sum_score, coalesce(won / total, 0) AS weighted_score FROM tot CROSS JOIN (SELECT DISTINCT model FROM oc) md LEFT JOIN won ON won.input_id = tot.input_id AND won.model = md.model),
top AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY weighted_score DESC, model) = 1)"""


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "embeddings")
    return retrieve.knn(base.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "input_id"), base)


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("m")).where("(vec_id + m) % 11 <> 0")
    return rows.select("vec_id", F.concat(F.lit("m"), "m").alias("model"), ((F.col("label") + F.col("vec_id") % 7 + F.col("m")) % 3 == 0).cast("int").alias("success"))


@query("knn_topk", f"WITH {_NEIGHBOURS} SELECT input_id, vec_id, round(d2, 6) AS d2, round(score, 6) AS score, rank FROM nb")
def _knn(spark, d):
    return neighbours(spark, d)


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    base = table(spark, d, "embeddings")
    path = shared_path(spark, "ivf")
    ivf.build(base, path)
    return base.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "input_id"), base, path


@query("ann_topk")
def _ann(spark, d):
    """Approximate: as many cells as a measured recall of 0.97 takes; tests hold the recall against exact search."""
    asked, base, path = _indexed(spark, d)
    return ivf.search(asked, path, 10, ivf.tuned_probes(asked, base, path))


@query("ann_all_cells", f"WITH {_NEIGHBOURS} SELECT input_id, vec_id, round(d2, 6) AS d2, round(score, 6) AS score, rank FROM nb")
def _ann_all(spark, d):
    """Every cell probed: codes choose 1000 candidates a query, whole vectors rank them."""
    asked, _, path = _indexed(spark, d)
    return ivf.search(asked, path, 10, ivf.MOST_CELLS, oversample=100)


@query("hit_mix", f"WITH {_NEIGHBOURS} SELECT value, hits, count(*) AS queries FROM (SELECT input_id, CAST(label AS BIGINT) AS value, count(*) AS hits FROM nb JOIN embeddings USING (vec_id) GROUP BY ALL) GROUP BY ALL")
def _hit_mix(spark, d):
    return retrieve.hit_mix(neighbours(spark, d), table(spark, d, "embeddings"), "label")


@query("vote_weighted", f"WITH {_VOTE} SELECT input_id, model, sum_score, round(weighted_score, 6) AS weighted_score FROM vote")
def _vote(spark, d):
    return retrieve.vote(neighbours(spark, d), outcomes(spark, d))


@query("top_model", f"WITH {_VOTE} SELECT input_id, model, sum_score, round(weighted_score, 6) AS weighted_score FROM top")
def _top_model(spark, d):
    return retrieve.top_model(retrieve.vote(neighbours(spark, d), outcomes(spark, d)))


@query(
    "selection_accuracy",
    f"""WITH {_VOTE} SELECT count(*) AS n, round(avg(coalesce(oc.success, 0)), 6) AS accuracy, round(avg(coalesce(best.any_right, 0)), 6) AS oracle_accuracy
FROM top LEFT JOIN oc ON oc.vec_id = top.input_id AND oc.model = top.model LEFT JOIN (SELECT vec_id, max(success) AS any_right FROM oc GROUP BY vec_id) best ON best.vec_id = top.input_id""",
)
def _selection(spark, d):
    o = outcomes(spark, d)
    return retrieve.selection_accuracy(retrieve.top_model(retrieve.vote(neighbours(spark, d), o)), o)


@query("success_multiplicity", f"WITH {_OUTCOMES} SELECT solved_by, count(*) AS cnt FROM (SELECT vec_id, CAST(sum(success) AS BIGINT) AS solved_by FROM oc GROUP BY vec_id) GROUP BY solved_by")
def _solved(spark, d):
    return retrieve.success_multiplicity(outcomes(spark, d))


def wide_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).groupBy("vec_id").pivot("model", ["m0", "m1", "m2"]).agg(F.max("success")).na.fill(0)


_WIDE = f"{_OUTCOMES}, wide AS (SELECT vec_id, " + ", ".join(f"coalesce(max(success) FILTER (model = 'm{m}'), 0) AS m{m}" for m in range(3)) + " FROM oc GROUP BY vec_id)"


@query("model_crosstab", f"WITH {_WIDE} SELECT model, CAST(value AS BIGINT) AS value, count(*) AS cnt FROM (SELECT 'm0' AS model, m0 AS value FROM wide UNION ALL SELECT 'm1', m1 FROM wide UNION ALL SELECT 'm2', m2 FROM wide) GROUP BY ALL")
def _crosstab(spark, d):
    return retrieve.compare_models(wide_outcomes(spark, d), ["m0", "m1", "m2"])


@query("others_only", f"WITH {_WIDE} SELECT vec_id, CAST(m0 AS BIGINT) AS m0, CAST(m1 AS BIGINT) AS m1, CAST(m2 AS BIGINT) AS m2 FROM wide WHERE greatest(m0, m1) = 1 AND m2 = 0")
def _others(spark, d):
    return retrieve.others_only(wide_outcomes(spark, d), "m2", ["m0", "m1"])


# Conversations, chunks, prompts


@query("convo_tokens", "SELECT conv_id, count(*) AS messages, CAST(sum(length(coalesce(text, '')) + 1) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def _convo_tokens(spark, d):
    return convo.conversation_tokens(table(spark, d, "conversations"))


_CONTEXT = "CASE conv_id % 5 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} ELSE {} END"
_kind = _CONTEXT.format("'together'", "'openai'", "'anthropic'", "'local'")


@query("convo_available_tokens", f"SELECT conv_id, greatest({_CONTEXT.format(8193 - 100, 8000 - 200, 100000 - 1000, 4000 - 200)} - sum((length(coalesce(text, ''))) // 4) * 40, 50)::BIGINT AS available FROM conversations GROUP BY conv_id")
def _available(spark, d):
    used = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(prompts.estimate_tokens(F.col("text"))).alias("used"))
    return used.select("conv_id", prompts.available_tokens(F.expr(_kind), F.col("used") * 40).alias("available"))


@query(
    "convo_truncate",
    """WITH t AS (SELECT *, length(coalesce(text, '')) // 4 AS n FROM conversations), u AS (SELECT *, sum(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
sum(CASE WHEN role = 'system' THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM t)
SELECT conv_id, turn, role FROM u WHERE role = 'system' OR used + sys <= 150""",
)
def _truncate(spark, d):
    return convo.truncate(table(spark, d, "conversations"), 150).select("conv_id", "turn", "role")


@query("convo_last_n", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def _last(spark, d):
    return convo.last_turns(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


@query(
    "chunk_pack",
    """WITH RECURSIVE t AS (SELECT n_regionkey, n_nationkey, length(repeat(n_name, 12)) // 4 AS tokens, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation),
fold AS (SELECT n_regionkey, n_nationkey, tokens, r, 0 AS chunk, tokens AS used FROM t WHERE r = 1 UNION ALL
SELECT t.n_regionkey, t.n_nationkey, t.tokens, t.r, CASE WHEN used > 0 AND used + t.tokens + 5 > 60 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + t.tokens + 5 > 60 THEN t.tokens ELSE used + t.tokens END
FROM fold JOIN t ON t.n_regionkey = fold.n_regionkey AND t.r = fold.r + 1)
SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(tokens AS BIGINT) AS tokens, CAST(chunk AS BIGINT) AS chunk FROM fold""",
)
def _chunks(spark, d):
    nations = table(spark, d, "nation").withColumn("ddl", F.repeat("n_name", 12))
    return convo.chunk_schemas(nations, "n_regionkey", "n_nationkey", "ddl", 60, 5)


@query("large_schemas", "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, sum(length(text) // 4) > 6000 AS is_large FROM documents GROUP BY source")
def _large(spark, d):
    return convo.large_schemas(table(spark, d, "documents"), "source", "text")


_LINE = "concat('Table: ', n_name, ' Description: ', '', ' DDL: ', 'CREATE TABLE ', n_name, ' (id INT)')"


def region_tables(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").withColumn("t", F.struct(F.col("n_name").alias("table_name"), F.lit(None).cast("string").alias("description"), F.concat(F.lit("CREATE TABLE "), "n_name", F.lit(" (id INT)")).alias("DDL")))
    return nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("t")).alias("tables"))


@query("schema_text", f"SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg({_LINE}, chr(10) ORDER BY n_name) AS schema_text FROM nation GROUP BY n_regionkey")
def _schema_text(spark, d):
    return region_tables(spark, d).select("n_regionkey", prompts.schema_text(F.col("tables")).alias("schema_text"))


@query(
    "prompt_build",
    f"""SELECT k, concat_ws(chr(10) || chr(10), 'Write one SQL query that answers the question over this schema.', 'S', concat('Question: ', t, CASE WHEN k % 3 = 0 THEN ' (PS : note)' ELSE '' END)) AS prompt FROM ({_CUSTOMERS})""",
)
def _prompt(spark, d):
    return questions(spark, d).select("k", prompts.sql_prompt(F.lit("S"), F.col("t"), F.expr("CASE WHEN k % 3 = 0 THEN 'note' ELSE '' END")).alias("prompt"))


# Execution of statements over the tables

#: What models say to each nation's gold statement; {n} is its key.
GOLD = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = {n};"
SAID = {
    "reordered": "SELECT c_custkey AS id, c_mktsegment FROM customer WHERE c_nationkey BETWEEN {n} AND {n} ORDER BY c_mktsegment DESC",
    "solvent": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = {n} AND c_acctbal >= 0",
    "buying": "SELECT c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = {n}",
    "counting": "SELECT count(*) FROM customer WHERE c_nationkey = {n}",
    "unknown": "SELECT c_nothing FROM customer",
    "silent": "",
}


def said(spark: SparkSession, d: str) -> DataFrame:
    """(n, model, sql, generated_sql): every model's statement for every nation."""
    fill = lambda text: F.replace(F.lit(text), F.lit("{n}"), F.col("n").cast("string"))
    answers = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), fill(t).alias("generated_sql")) for m, t in SAID.items()]))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    return nations.select("n", fill(GOLD).alias("sql"), answers.alias("a")).select("n", "a.model", "sql", "a.generated_sql")


@query(
    "execution_accuracy",
    f"""WITH c AS (SELECT n_nationkey AS n, count(c_custkey) = count(CASE WHEN c_acctbal >= 0 THEN 1 END) AS solvent, bool_and(c_custkey IS NULL OR c_custkey IN (SELECT o_custkey FROM orders)) AS buying
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
m AS (SELECT CAST(n AS BIGINT) AS n, solvent, buying, unnest({listed(list(SAID))}) AS model FROM c),
v AS (SELECT n, model, CASE model WHEN 'reordered' THEN true WHEN 'solvent' THEN solvent WHEN 'buying' THEN buying WHEN 'silent' THEN NULL ELSE false END AS execution_correct FROM m)
SELECT *, CASE WHEN model = 'counting' THEN 'Results have different column sets' WHEN model = 'unknown' THEN 'failed' WHEN NOT execution_correct THEN 'Results have different rows' END AS reason FROM v""",
)
def _execution(spark, d):
    session = spark.newSession()  # the views are its own
    for name in ("customer", "orders"):
        session.read.parquet(f"{d}/{name}.parquet").createOrReplaceTempView(name)
    out = execute.check_executions(said(spark, d), session=session)
    reason = F.when(F.col("execution_error").startswith(execute.FAILED), "failed").otherwise(F.col("execution_error"))
    return out.select("n", "model", "execution_correct", reason.alias("reason"))


# Catalogs and model calls

@query("ddl_columns", f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS table_name, position, name, type, is_pk FROM ({_COLUMNS})")
def _ddl_columns(spark, d):
    return ddl.schema_columns(parsed_nations(spark, d), ["n_nationkey"])


@query("ddl_foreign_keys", f'SELECT n_name AS table_name, "column", references_schema, references_table, references_column FROM ({_FOREIGN_KEYS})')
def _ddl_keys(spark, d):
    return ddl.schema_foreign_keys(parsed_nations(spark, d), [])


@query("schema_analysis", f"SELECT * REPLACE (CAST(n_regionkey AS BIGINT) AS n_regionkey), round(columns_count / tables_count, 6) AS columns_per_table FROM ({schema_counts_sql('SELECT n_regionkey, n_nationkey FROM nation', 'n_regionkey')})")
def _schema_analysis(spark, d):
    return ddl.analyze_schema(parsed_nations(spark, d), ["n_regionkey"]).drop("datatype_counts")


def unanswered(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked: no analyses, as a prediction needs none and its rows pass a task of Python."""
    tables = F.array(F.struct(F.col("db_id").alias("table_name"), F.lit("").alias("description"), F.lit("").alias("DDL")))
    return plain_instances(spark, d).select("id", "dataset", "db_id", "database", "question", "evidence", tables.alias("schema_tables"))


@query("predict_in_conversation", "SELECT c_custkey AS id, concat('SELECT * FROM ', c_mktsegment) AS generated_sql, true AS has_prediction FROM customer")
def _predict(spark, d):
    return predict(unanswered(spark, d), EchoProvider).select("id", "generated_sql", "has_prediction")


class CountingProvider:
    """Answers with how many messages it was given, how many questions among them, and how many before the last answer."""

    def generate(self, system: str, messages: list[dict[str, str]]) -> str:
        asked = sum(m["role"] == "user" for m in messages)
        last = next((m["content"] for m in reversed(messages) if m["role"] == "assistant"), "none")
        return f"```sql\nSELECT {len(messages)}, {asked}, '{last.split(',')[0][-2:].strip()}' FROM t\n```"


@query(
    "predict_with_history",
    """WITH t AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS turn FROM customer),
g AS (SELECT id, turn, 2 + least(2 * turn, 20) AS given, 2 + least(2 * (turn - 1), 20) AS before FROM t)
SELECT id, concat('SELECT ', given, ', ', given - (given - 2) // 2, ', ', chr(39), CASE WHEN turn = 0 THEN 'ne' ELSE CAST(before AS VARCHAR) END, chr(39), ' FROM t') AS generated_sql, true AS has_prediction FROM g""",
)
def _predict_history(spark, d):
    """Each reply depends on how many turns came before it and on the last reply."""
    return predict(unanswered(spark, d), CountingProvider, at_once=4).select("id", "generated_sql", "has_prediction")
