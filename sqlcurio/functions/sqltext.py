"""Analysis of SQL text as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
CLAUSES = ["GROUP BY", "HAVING", "ORDER BY", "LIMIT"]
AGGREGATES = ["COUNT", "AVG", "SUM", "MIN", "MAX"]
VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"]
KEYWORDS = [
    "ALL", "AND", "AS", "ASC", "BETWEEN", "BY", "CASE", "CAST", "CREATE", "CROSS", "DELETE", "DESC", "DISTINCT", "DROP", "ELSE",
    "END", "EXCEPT", "EXISTS", "FROM", "FULL", "GROUP", "HAVING", "IN", "INNER", "INSERT", "INTERSECT", "INTO", "IS", "JOIN",
    "LEFT", "LIKE", "LIMIT", "NOT", "NULL", "OFFSET", "ON", "OR", "ORDER", "OUTER", "OVER", "PARTITION", "RIGHT", "SELECT", "SET",
    "TABLE", "THEN", "UNION", "UPDATE", "USING", "VALUES", "WHEN", "WHERE", "WITH",
]
MODERATE_ABOVE, CHALLENGING_ABOVE = 80, 160
# also fixed: the patterns of tables, where_conditions and select_columns, which golden values hold

#: A token: a quoted run, a word, a number, an operator or any other visible character.
TOKEN = r"""'[^']*'|"[^"]*"|[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:[.][0-9]+)?|[<>!=]+|[^\s]"""
#: The same with runs of blanks, for rewriting a statement piece by piece.
PIECE = r"""'[^']*'|"[^"]*"|[A-Za-z_][A-Za-z0-9_]*|\s+|[^\sA-Za-z_'"]+|['"]"""


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tables(sql: Column) -> Column:
    """Distinct names behind FROM and JOIN without quoting characters, sorted."""
    names = F.concat(_all(sql, r"(?i)\bFROM\s+([^\s,]+)"), _all(sql, r"(?i)\bJOIN\s+([^\s]+)"))
    return F.array_sort(F.array_distinct(F.transform(names, lambda t: F.btrim(t, F.lit("`\"'[]")))))


def where_conditions(sql: Column) -> Column:
    body = F.regexp_extract(sql, r"(?is)WHERE\s+(.*?)(?:GROUP BY|ORDER BY|LIMIT|HAVING|$)", 1)
    upper = F.upper(body)
    has = sql.rlike(r"(?is)WHERE\s+")
    return F.when(has, F.regexp_count(upper, F.lit(" AND ")) + F.regexp_count(upper, F.lit(" OR ")) + 1).otherwise(0)


def select_columns(sql: Column) -> Column:
    """Top-level items between the first SELECT and FROM, brackets of any depth left out; a star counts as one."""
    body = F.trim(F.regexp_extract(sql, r"(?is)SELECT\s+(.*?)\s+FROM", 1))
    open_brackets = F.length(body) - F.length(F.replace(body, F.lit("("), F.lit("")))
    rounds = F.when(open_brackets > 0, F.sequence(F.lit(1), open_brackets)).otherwise(F.array().cast("array<int>"))
    flat = F.aggregate(rounds, body, lambda text, _: F.regexp_replace(text, r"\([^()]*\)", ""))
    flat = F.regexp_replace(flat, r",\s*$", "")
    return F.when(body == "", 0).when(body == "*", 1).otherwise(F.regexp_count(flat, F.lit(",")) + 1)


def analyze_sql(sql: Column) -> Column:
    """All structural metrics of a statement; null and blank text give zeros and an error."""
    sql = F.coalesce(sql, F.lit(""))
    upper = F.upper(sql)
    names = tables(sql)
    # no higher-order functions here, as expressions within them aren't shared
    counts = [F.regexp_count(sql, F.lit(rf"(?i)\b{a}\s*\(")) for a in AGGREGATES]
    listed = lambda names, tests: F.array_remove(F.array(*[F.when(t, n).otherwise("") for n, t in zip(names, tests, strict=True)]), "")
    clauses = listed(CLAUSES, [F.contains(upper, F.lit(c)) for c in CLAUSES])
    found = listed(AGGREGATES, [n > 0 for n in counts])
    return F.struct(
        F.length(sql).alias("char_length"),
        F.size(names).alias("tables_count"),
        names.alias("tables"),
        F.regexp_count(upper, F.lit("JOIN")).alias("join_count"),
        where_conditions(sql).cast("int").alias("where_conditions"),
        F.greatest(F.regexp_count(upper, F.lit("SELECT")) - 1, F.lit(0)).alias("subquery_count"),
        F.size(clauses).alias("clauses_count"),
        clauses.alias("clause_types"),
        reduce(add, counts).alias("aggregation_function_count"),
        found.alias("aggregation_functions"),
        select_columns(sql).cast("int").alias("select_columns"),
        F.when(F.trim(sql) == "", F.lit("empty statement")).alias("error"),
    )


def token_count(sql: Column) -> Column:
    return F.regexp_count(F.coalesce(sql, F.lit("")), F.lit(TOKEN))


def difficulty(sql: Column) -> Column:
    n = token_count(sql)
    return F.when(n > CHALLENGING_ABOVE, "challenging").when(n > MODERATE_ABOVE, "moderate").otherwise("simple")


def normalize_sql(sql: Column) -> Column:
    """First statement, keywords outside quotes in upper case, blanks collapsed; other names keep their case."""
    first = F.regexp_extract(F.coalesce(sql, F.lit("")), r"""(?s)^\s*((?:'[^']*'|"[^"]*"|[^;'"]|['"])*)""", 1)
    # a piece that begins with a blank has nothing else
    rewrite = lambda p: F.when(F.ascii(p).isin(9, 10, 11, 12, 13, 32), " ").when(F.upper(p).isin(KEYWORDS), F.upper(p)).otherwise(p)
    return F.trim(F.array_join(F.transform(_all(first, f"({PIECE})"), rewrite), ""))


def exact_match(gold: Column, predicted: Column) -> Column:
    return F.coalesce(normalize_sql(gold) == normalize_sql(predicted), F.lit(False))


def extract_sql(reply: Column, lenient_json: bool = True) -> Column:
    """The statement in a model's reply: JSON field, sql fence, other fence with a verb, bare statement, else ''.

    ``lenient_json`` also reads JSON whose strings hold raw line breaks.
    """
    text = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)<think>.*?</think>", "")
    strip = lambda x: F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))
    hit = lambda pattern: strip(F.regexp_extract(text, pattern, 1))
    body = F.regexp_extract(text, r'(?s)(\{.*"sql".*\})', 1)
    if lenient_json:
        body = F.regexp_replace(body, r"[\n\r\t]", " ")
    verb = "(?:" + "|".join(VERBS) + ")"
    return F.coalesce(
        strip(F.get_json_object(body, "$.sql")),
        hit(r"(?is)```sql\s*(.*?)```"),
        hit(rf"(?is)```[a-z]*\s*([^`]*\b{verb}\b[^`]*)```"),
        hit(r"(?is)(\bSELECT\b.*?\bFROM\b.*?(?:;|$))"),
        hit(r"(?is)(\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE)\b.*?(?:;|$))"),
        hit(rf"(?is)the sql query is:?\s*(.*\b{verb}\b.*)"),
        F.lit(""),
    )


def query_type(a: Column) -> Column:
    """Kind of a statement from its analysis, by precedence."""
    has = lambda c: F.array_contains(a["clause_types"], c)
    return (
        F.when((a["subquery_count"] > 0) & has("GROUP BY"), "nested_with_groupby")
        .when(a["subquery_count"] > 0, "nested")
        .when(has("GROUP BY") & has("HAVING"), "groupby_having")
        .when(has("GROUP BY"), "groupby")
        .when(a["join_count"] > 0, "join")
        .when(has("ORDER BY"), "orderby")
        .otherwise("simple")
    )


def schema_size(tables_in_schema: Column) -> Column:
    return F.when(tables_in_schema.isNull(), "unknown").when(tables_in_schema <= 3, "small").when(tables_in_schema <= 7, "medium").otherwise("large")


def question_length_class(question: Column) -> Column:
    n = F.length(F.coalesce(question, F.lit("")))
    return F.when(n < 30, "short").when(n < 70, "medium").otherwise("long")


def strat_variable(a: Column, tables_in_schema: Column, question: Column) -> Column:
    """One stratum name: type of query, size of schema, first aggregate if any, length of question."""
    aggregate = F.when(F.size(a["aggregation_functions"]) > 0, F.concat(F.lit("agg_"), F.try_element_at(a["aggregation_functions"], F.lit(1))))
    return F.concat_ws("_", query_type(a), schema_size(tables_in_schema), aggregate, question_length_class(question))
