"""Statements run once each; verdicts by fingerprints against the rows themselves."""

import time

from pyspark.sql import functions as F

from sqlcurio.operators import evaluate, execute

STATEMENTS = [
    "SELECT 1 AS a", "SELECT 1.0D", "SELECT 1.00", "SELECT true", "SELECT '1'", "SELECT 2", "SELECT -0.0D", "SELECT 0", "SELECT CAST(NULL AS INT)", "SELECT CAST(NULL AS STRING)", "SELECT ''",
    "SELECT id FROM range(100)", "SELECT id FROM range(100) ORDER BY id DESC", "SELECT CAST(id AS DOUBLE) FROM range(100)", "SELECT id FROM range(101)", "SELECT id % 100 FROM range(300)", "SELECT id, id FROM range(100)",
    "SELECT id / 4 FROM range(8)", "SELECT CAST(id AS DECIMAL(30, 10)) / 4 FROM range(8)", "SELECT id * 0.25D FROM range(8)", "SELECT 12345678.5D", "SELECT 12345678.50", "SELECT 1e300D", "SELECT 1e-9D", "SELECT 0.000000001",
    "SELECT DATE '2020-01-01'", "SELECT DATE '2020-01-02'", "SELECT X'00ff'", "SELECT array(1, 2)", "SELECT array(2, 1)", "SELECT 1 WHERE false", "SELECT id FROM range(0)", "SELECT 9007199254740993", "SELECT 9007199254740992",
    "WITH t AS (SELECT 'insert into x' AS s) SELECT s FROM t", "(SELECT 1)",
]


def test_verdicts_equal_those_of_the_rows(spark):
    pairs = spark.createDataFrame([(g, p) for g in STATEMENTS for p in STATEMENTS], "sql string, generated_sql string")
    freeze = lambda v: tuple(v) if isinstance(v, list) else float(v) if type(v).__name__ == "Decimal" and v % 1 else v
    rows = {s: [tuple(map(freeze, r)) for r in spark.sql(s).collect()] for s in STATEMENTS}
    width = {s: len(spark.sql(s).columns) for s in STATEMENTS}
    results = execute.run_statements(pairs.select("sql")).cache()
    assert results.count() == len(STATEMENTS) and results.where("error is not null").count() == 0
    for bag in (False, True):
        form = sorted if bag else set
        out = execute.verdicts(pairs, results, bag=bag).collect()
        assert len(out) == len(STATEMENTS) ** 2  # 1296
        for r in out:
            a, b = rows[r["sql"]], rows[r["generated_sql"]]
            if width[r["sql"]] != width[r["generated_sql"]]:
                want = (False, execute.OTHER_COLUMNS)
            else:
                equal = set(a) == set(b) if form is set else sorted(map(repr_of, a)) == sorted(map(repr_of, b))
                want = (equal, None if equal else execute.OTHER_ROWS)
            assert (r["execution_correct"], r["execution_error"]) == want, r


def repr_of(row):
    """Numbers of one value have one form."""
    number = lambda v: str(int(v)) if v == int(v) and abs(v) < 1e18 else repr(float(v))
    return repr(["null" if v is None else number(v) if not isinstance(v, (str, tuple, bytes, bytearray)) and not hasattr(v, "year") else repr(v) for v in row])


def test_verdicts_equal_the_union_of_both_sides(spark):
    spark.createDataFrame([(k % 7, None if k % 5 == 0 else f"v{k % 3}", k / 8) for k in range(60)], "a long, b string, c double").createOrReplaceTempView("e_rows")
    said = ["SELECT a, b FROM e_rows", "SELECT DISTINCT a, b FROM e_rows", "SELECT a, b FROM e_rows WHERE c >= 0 ORDER BY c", "SELECT a, max(b) FROM e_rows GROUP BY a", "SELECT a, b FROM e_rows UNION ALL SELECT a, b FROM e_rows", "SELECT cast(a AS INT), b FROM e_rows LIMIT 59"]
    pairs = spark.createDataFrame([(g, p) for g in said for p in said], "sql string, generated_sql string")
    for bag in (False, True):
        for r in execute.check_executions(pairs, bag=bag).collect():
            equal, why = evaluate.check_execution(spark, r["sql"], r["generated_sql"], bag=bag)
            assert (r["execution_correct"], r["execution_error"] or "") == (equal, why)


def test_each_statement_runs_once_and_failures_are_recorded(spark, monkeypatch):
    ran = []
    keep = execute._run_one
    monkeypatch.setattr(execute, "_run_one", lambda s, statement, *rest: ran.append(statement) or keep(s, statement, *rest))
    monkeypatch.setattr(execute, "BATCH", 2)
    spark.range(3).createOrReplaceTempView("e_three")
    rows = [("SELECT id FROM e_three;", " SELECT id FROM e_three \n", True), ("SELECT id FROM e_three", "SELECT nope FROM e_three", False), ("SELECT id FROM e_three", "DROP TABLE e_three", False)]
    rows += [("SELECT 1", None, None), (None, "SELECT 1", None), ("SELECT 1", "", None), ("WITH t AS (SELECT 1) INSERT INTO e_three SELECT * FROM t", "SELECT 1", False), ("SELECT 1; SELECT 2", "SELECT 1", False), ("SELECT id FROM e_three", "SELECT id FROM e_three", True)]
    out = execute.check_executions(spark.createDataFrame([(*r, "old") for r in rows], "sql string, generated_sql string, want boolean, execution_error string"))
    assert out.columns == ["sql", "generated_sql", "want", "execution_correct", "execution_error"]
    assert all(r["execution_correct"] == r["want"] for r in out.collect()) and out.count() == len(rows)
    assert len(ran) == len(set(ran)) == 6
    errors = {r["generated_sql"]: r["execution_error"] for r in out.collect() if r["sql"] == "SELECT id FROM e_three"}
    assert errors["SELECT nope FROM e_three"].startswith(execute.FAILED) and errors["DROP TABLE e_three"] == execute.FAILED + execute.UNREADABLE
    assert all(r["execution_error"].startswith(execute.GOLD_FAILED) for r in out.where("sql like 'WITH%' or sql like '%; %'").collect())
    assert spark.table("e_three").count() == 3
    assert execute.check_executions(spark.createDataFrame([], "sql string, generated_sql string")).count() == 0


def test_a_runaway_statement_is_cancelled_and_the_others_are_not(spark):
    run = "SELECT sum(hash(a.id, b.id)) FROM range(3000000) a JOIN range(3000000) b ON a.id % 2 = b.id % 2"
    said = spark.createDataFrame([(run,), ("SELECT 1",), ("SELECT sum(id) FROM range(1000)",)], "s string")
    began = time.monotonic()
    found = {r["statement"]: r["error"] for r in execute.run_statements(said, seconds=4).collect()}
    assert time.monotonic() - began < 60
    assert found.pop(run) == "cancelled after 4 s" and set(found.values()) == {None}
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_fingerprints_depend_neither_on_order_nor_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").cast("string").alias("v"))
    prints = {tuple(execute.fingerprint(d).first()) for d in (df, df.repartition(7), df.orderBy(F.desc("v")).coalesce(1))}
    assert len(prints) == 1 and prints.pop()[1:3] == (1000, 1000)
    assert tuple(execute.fingerprint(df.limit(0)).first())[:3] == (2, 0, 0)
