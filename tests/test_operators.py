"""Operators against loops and fixed cases of our own."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sqlcurio.functions import nl, prompts, sqltext
from sqlcurio.operators import convo, evaluate, features, profile, retrieve, sampling, standardize
from sqlcurio.plans import process
from sqlcurio.plans.providers import EchoProvider, converse, generate, hashed_embedding
from sqlcurio.sources import ddl, readers, sinks
from sqlcurio.streaming import live


def counts(spark, sizes):
    return spark.createDataFrame([(k, n) for k, n in sizes.items()], "db string, cnt long")


def half_even(x):
    return round(x)


def loop_proportional(sizes, target, least):
    total = sum(sizes.values())
    a = {k: min(max(least, half_even(n / total * target)), n) for k, n in sizes.items()}
    for k in sorted(sizes, key=lambda k: (-sizes[k], k)):
        need = target - sum(a.values())
        if need > 0:
            a[k] += min(need, sizes[k] - a[k])
    for k in sorted(sizes, key=lambda k: (sizes[k], k)):
        need = sum(a.values()) - target
        if need > 0:
            a[k] -= min(need, max(a[k] - least, 0))
    return a


def quotas(df):
    return {r["db"]: r["quota"] for r in df.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_proportional_quota_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"d{k:02d}": rnd.randint(1, rnd.choice([3, 30, 300])) for k in range(rnd.randint(1, 12))}
    for target, least in ((rnd.randint(1, 400), 1), (rnd.randint(1, 50), 3)):
        assert quotas(sampling.proportional_quota(counts(spark, sizes), ["db"], target, least)) == loop_proportional(sizes, target, least)


def test_uniform_quota(spark):
    assert quotas(sampling.uniform_quota(counts(spark, {"a": 10, "b": 4, "c": 6}), ["db"], 11)) == {"a": 4, "b": 3, "c": 4}
    assert quotas(sampling.uniform_quota(counts(spark, {"a": 10, "b": 2}), ["db"], 11)) == {"a": 2, "b": 2}
    assert quotas(sampling.uniform_quota(counts(spark, {}), ["db"], 11)) == {}


def test_largest_remainder(spark):
    got = quotas(sampling.largest_remainder_quota(counts(spark, {"a": 5, "b": 3, "c": 2}), ["db"], 4))
    assert got == {"a": 2, "b": 1, "c": 1}


def test_two_level_shrinks_to_what_is_feasible(spark):
    rows = [("easy", "a", 100), ("easy", "b", 3), ("hard", "a", 50), (None, "z", 20)]
    df = spark.createDataFrame(rows, "lvl string, db string, cnt long")
    got = sampling.two_level_quota(df, "lvl", "db", 100).collect()
    assert all(r["quota"] <= r["cnt"] for r in got) and len(got) == 4


def test_quota_sample_is_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 < 9, "big").when(F.col("id") % 20 == 9, None).otherwise("small").alias("db"))
    q = sampling.proportional_quota(sampling.strata(df, ["db"]), ["db"], 777)
    a, b = (sorted(r["id"] for r in sampling.quota_sample(d, q, ["db"], "id").collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 777
    test = sampling.split(df, "id", 0.2).where("is_test").count()
    assert test == 1000


SQL = [
    ("SELECT a, count(*), max((b + (c))) FROM `t` JOIN \"u\" ON t.x = u.x WHERE a BETWEEN 1 AND 2 AND b = 1 OR c = 2 GROUP BY a ORDER BY a LIMIT 3", dict(tables=["t", "u"], join_count=1, where_conditions=4, subquery_count=0, clauses_count=3, aggregation_function_count=2, select_columns=3)),
    ("SELECT * FROM (SELECT x FROM t) s", dict(tables=["(SELECT", "t)"], subquery_count=1, select_columns=1, where_conditions=0)),
    ("", dict(tables=[], select_columns=0, error="empty statement", char_length=0)),
    (None, dict(tables=[], error="empty statement")),
    ("select 1", dict(select_columns=0, tables=[], clauses_count=0)),
    ("SELECT f(a, g(b, h(c, i(d, e)))), x, FROM t", dict(select_columns=2)),
]


@pytest.mark.parametrize("k", range(len(SQL)))
def test_sql_analysis(spark, k):
    sql, want = SQL[k]
    got = spark.createDataFrame([(sql,)], "s string").select(sqltext.analyze_sql(F.col("s")).alias("a")).first()["a"].asDict()
    assert {c: got[c] for c in want} == want


def test_difficulty_thresholds(spark):
    rows = [(" + ".join(["a"] * n),) for n in (40, 41, 80, 81)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(sqltext.difficulty(F.col("s"))).collect()]
    assert got == ["simple", "moderate", "moderate", "challenging"]


REPLIES = {
    '<think>SELECT no</think>{"sql": "SELECT 1 FROM t"}': "SELECT 1 FROM t",
    '```json\n{"sql": "SELECT a\nFROM t"}\n```': "SELECT a FROM t",
    "x ```sql\nselect 1\n``` y": "select 1",
    "```\nUPDATE t SET a = 1\n```": "UPDATE t SET a = 1",
    "so: SELECT a FROM t; and more": "SELECT a FROM t;",
    "CREATE TABLE x (a int)": "CREATE TABLE x (a int)",
    "nothing here": "", None: "",
}


def test_extract_sql(spark):
    df = spark.createDataFrame([(k,) for k in REPLIES], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", sqltext.extract_sql(F.col("t")).alias("x")).collect()} == REPLIES


def test_exact_match_keeps_case_of_names(spark):
    rows = [("select a from t", "SELECT  a\nFROM t;", True), ("SELECT count(*) FROM t", "SELECT COUNT(*) FROM t", False), ("SELECT 'from'", "SELECT 'FROM'", False), (None, None, True)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", sqltext.exact_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_question_analysis(spark):
    text = "How many more than five orders aren't from 2020-01-02, at most $5.20 or 3%?"
    a = spark.createDataFrame([(text,)], "t string").select(nl.analyze_question(F.col("t"), F.array(F.lit("Orders")), F.array(F.lit("order"))).alias("a")).first()["a"]
    assert a["numbers"][0] == "five" and a["has_negation"] and a["comparatives"] == ["more"] and a["superlatives"] == ["most"]
    assert a["table_overlap_count"] == 1 and a["column_overlap_count"] == 0 and a["column_overlap_lemma_count"] == 1
    assert all(text[e["start"] : e["end"]] == e["text"] for e in a["entities"]) and {"DATE", "MONEY", "PERCENT"} <= set(a["entity_types"])


def test_places_of_entities(spark):
    """Every entity of a text with many lies where it says it does, as an independent search finds it."""
    import re

    rnd = random.Random(4)
    bits = ["2019-03-01", "10:30", "$1,200.50", "12%", "seven", "first", "May 4", " é ", "\U0001f600", " ", ", ", "x7", "the 3rd", ""]
    texts = ["", " ", "no hits", *["".join(rnd.choice(bits) + rnd.choice([" ", "", "; "]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, q string").select("id", nl.analyze_question(F.col("q")).alias("a")).collect()
    for r in rows:
        want = [(m[0], label, m.start(), m.end()) for label, p in nl.ENTITY_PATTERNS.items() for m in re.finditer(p, texts[r["id"]])]
        assert [tuple(e) for e in r["a"]["entities"]] == want and r["a"]["has_entities"] == bool(want)


def test_features_of_nulls(spark):
    raw = spark.createDataFrame([(1, None, None, None), (2, "How many?", "SELECT 1", "note")], "id long, question string, sql string, evidence string")
    rows = process.enrich(standardize.standardize(raw, "bird"))
    both = features.combine_features(features.question_features(rows), features.sql_features(rows)).orderBy("id").collect()
    at_once = features.instance_features(rows).orderBy("id")
    assert at_once.columns == features.combine_features(features.question_features(rows), features.sql_features(rows)).columns and at_once.collect() == both
    assert "Join" not in at_once._jdf.queryExecution().optimizedPlan().toString()
    assert [r["has_evidence"] for r in both] == [0, 1] and both[0]["char_length"] == 0 and len(both) == 2  # null db_id matches null


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, b boolean, db string")
    assert profile.profile(empty, ["a"], ["b"], ["a"], "db").first().asDict() == {"total_examples": 0, "unique_dbs": 0, "avg_a": 0.0, "std_a": 0.0, "pct_b": 0.0, "min_a": None, "max_a": None, "mean_a": 0.0}


def test_execution(spark):
    spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a long, b string").createOrReplaceTempView("t_exec")
    ok = lambda g, p, **k: evaluate.check_execution(spark, g, p, **k)
    assert ok("SELECT a, b FROM t_exec", "SELECT DISTINCT a AS z, b FROM t_exec ORDER BY z DESC")[0]
    assert not ok("SELECT a, b FROM t_exec", "SELECT DISTINCT a, b FROM t_exec", bag=True)[0]
    assert ok("SELECT a FROM t_exec", "SELECT a, b FROM t_exec") == (False, "Results have different column sets")
    assert ok("SELECT a FROM t_exec", "SELECT nope FROM t_exec")[1].startswith("Execution error: ")
    assert ok("SELECT nope FROM t_exec", "SELECT 1")[1].startswith("Ground truth execution error: ")
    assert not ok("SELECT 1", "DROP TABLE t_exec")[0] and not ok("SELECT 1", "SELECT 1; DELETE FROM t_exec")[0]


def test_next_fit(spark):
    rnd, rows, want = random.Random(5), [], {}
    for key in range(20):
        chunk = used = 0
        for k in range(rnd.randint(1, 9)):
            n = rnd.choice([0, 3, 40, 200, 700])
            rows.append((key, k, "x" * (4 * n)))
            if used + n + 10 > 500 and used > 0:
                chunk, used = chunk + 1, n
            else:
                used += n
            want[key, k] = chunk
    tables = spark.createDataFrame(rows, "s long, k long, t string")
    got = convo.chunk_schemas(tables, "s", "k", "t", 500, 10)
    assert {(r["s"], r["k"]): r["chunk"] for r in got.collect()} == want
    packed = tables.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", F.floor(F.length("t") / 4).alias("n")))).alias("x"))
    arrays = packed.select("s", "x.k", convo.next_fit(F.col("x.n"), 500, 10).alias("c"))
    assert {(r["s"], k): c for r in arrays.collect() for k, c in zip(r["k"], r["c"], strict=True)} == want


def test_next_fit_of_one_schema_over_many_batches(spark):
    """A schema that spans Arrow batches keeps its open chunk; null keys, texts and arrays are defined."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        big = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 'hot' WHEN id < 990 THEN concat('s', id % 3) END AS s", "id AS k", "repeat('x', 40) AS t")
        got = convo.chunk_schemas(big, "s", "k", "t", 100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {}
    for r in sorted(got, key=lambda r: r["k"]):
        at.setdefault(r["s"], []).append(r["chunk"])
    assert {s: len(c) for s, c in at.items()} == {"hot": 900, "s0": 30, "s1": 30, "s2": 30, None: 10}
    assert all(c == [k // 10 for k in range(len(c))] for c in at.values())
    odd = spark.createDataFrame([(1, "a", None), (1, "b", "x" * 40)], "s int, k string, t string")
    assert sorted((r["k"], r["tokens"], r["chunk"]) for r in convo.chunk_schemas(odd, "s", "k", "t", 5).collect()) == [("a", 0, 0), ("b", 10, 0)]
    assert convo.chunk_schemas(odd.limit(0), "s", "k", "t").count() == 0
    arrays = spark.createDataFrame([(None,), ([],), ([6, None, 6],)], "a array<int>").coalesce(1)
    assert [r[0] for r in arrays.select(convo.next_fit(F.col("a"), 10)).collect()] == [None, [], [0, 0, 1]]


def test_truncate_keeps_system_and_newest(spark):
    rows = [(1, 0, "system", "ssss"), (1, 1, "user", "a" * 8), (1, 2, "assistant", "b" * 40), (1, 3, "user", None), (1, 4, "user", "c" * 8)]
    got = convo.truncate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 4)
    assert sorted(r["turn"] for r in got.collect()) == [0, 3, 4]


def test_knn_blocks_and_ties(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(k, [float(rnd.randint(0, 3)) for _ in range(4)]) for k in range(300)] + [(999, None)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = base.where("vec_id < 20").withColumnRenamed("vec_id", "input_id")
    want = {i: sorted((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), j) for j, w in rows[:300])[:5] for i, v in rows[:20]}
    for at_once, chunk in ((20, 100), (19, 100), (7, 40), (1, 3)):  # broadcast; blocks of queries that meet chunks of rows
        monkeypatch.setattr(retrieve, "QUERIES_AT_ONCE", at_once)
        monkeypatch.setattr(retrieve, "ROWS_AT_ONCE", chunk)
        got = {}
        for r in retrieve.knn(queries, base, 5).orderBy("input_id", "rank").collect():
            got.setdefault(r["input_id"], []).append((r["d2"], r["vec_id"]))
        assert got == want
    assert retrieve.knn(queries.limit(0), base).count() == 0 and retrieve.knn(queries, base.limit(0)).count() == 0


def test_knn_keeps_smallest_ids_of_many_copies(spark):
    vectors = [[0.1 * j for j in range(16)], [0.1 * j + 1e-9 for j in range(16)], [5.0] * 16]
    rows = [((k * 7919) % 3001, vectors[(k * 7919) % 3001 % 3]) for k in range(3001)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, vectors[0]), (2, vectors[2]), (3, [9.0] * 16)], "input_id long, embedding array<double>")
    got = {}
    for r in retrieve.knn(queries, base, 10).orderBy("input_id", "rank").collect():
        got.setdefault(r["input_id"], []).append(r["vec_id"])
    assert got == {1: list(range(0, 30, 3)), 2: list(range(2, 32, 3)), 3: list(range(2, 32, 3))}


def test_vote_counts_missing_as_failure(spark):
    nb = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.25)], "input_id long, vec_id long, score double")
    out = spark.createDataFrame([(10, "a", 1), (11, "b", 1), (12, "c", 1)], "vec_id long, model string, success int")
    got = {r["model"]: r["weighted_score"] for r in retrieve.vote(nb, out).collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3), "c": 0.0} and retrieve.top_model(retrieve.vote(nb, out)).first()["model"] == "a"


def test_vote_holds_every_model(spark, monkeypatch):
    nb = spark.createDataFrame([(1, 10, 0.5)], "input_id long, vec_id long, score double")
    out = spark.range(1500).selectExpr("10L AS vec_id", "concat('m', id) AS model", "CAST(id = 1499 AS INT) AS success")
    for at_once in (4096, 100):  # broadcast names; parts of them
        monkeypatch.setattr(retrieve, "MODELS_AT_ONCE", at_once)
        votes = retrieve.vote(nb, out)
        assert votes.count() == 1500 == votes.select("model").distinct().count() and retrieve.top_model(votes).first()["model"] == "m1499"


def test_ddl(spark):
    p = ddl.parse_ddl('CREATE OR REPLACE TRANSIENT TABLE db.s."My T" ("full name" TEXT, n NUMBER(38,0) NOT NULL, CONSTRAINT pk PRIMARY KEY (n, "full name"), b int REFERENCES "s2".o, UNIQUE (b), FOREIGN KEY (b, n) REFERENCES o2 (x, y))')
    assert p["table_name"] == "My T" and [(c["name"], c["type"], c["is_pk"]) for c in p["columns"]] == [("full name", "TEXT", True), ("n", "NUMBER(38,0)", True), ("b", "INT", False)]
    assert [(f["column"], f["references_schema"], f["references_table"], f["references_column"]) for f in p["foreign_keys"]] == [("b", "s2", "o", None), ("b", None, "o2", "x"), ("n", None, "o2", "y")]
    assert ddl.parse_ddl(None) is None and ddl.parse_ddl("nan") is None and ddl.parse_ddl("CREATE TABLE t (a)")["columns"][0]["type"] == "TEXT"


def test_readers_and_sinks(spark, tmp_path):
    base = tmp_path / "spider"
    base.mkdir()
    one = [{"db_id": "Db", "question": f"q{k}", "query": "SELECT 1"} for k in range(3)]
    (base / "train_spider.json").write_text(json.dumps(one))
    (base / "train_others.json").write_text(json.dumps(one[:2]))
    (base / "tables.json").write_text(json.dumps([{"db_id": "Db", "table_names": ["a t", "b"], "table_names_original": ["a_t", "b"], "column_names": [[-1, "*"], [0, "x"], [1, "y"]], "column_names_original": [[-1, "*"], [0, "X"], [1, "Y"]], "column_types": ["text", "number", "text"], "foreign_keys": [[2, 1]], "primary_keys": [1]}]))
    got = readers.get_dataset(spark, "spider", str(base), limit=4).orderBy("id").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3] and got[3]["question"] == "q0" and got[0]["db_id"] == "Db" and got[0]["question_uid"].startswith("spider_NO_g_")
    catalog = readers.spider_catalog(spark, str(base))
    assert [(r["table_id"], r["original_name"], r["is_pk"]) for r in catalog["columns"].orderBy("column_id").collect()] == [(-1, "*", False), (0, "X", True), (1, "Y", False)]
    assert catalog["foreign_keys"].first()["from_column_id"] == 2
    with pytest.raises(ValueError):
        readers.get_dataset(spark, "nope")

    lite = tmp_path / "lite"
    (lite / "sql").mkdir(parents=True)
    (lite / "lite.jsonl").write_text('{"instance_id": "i1", "db": "d", "instruction": "do", "external_knowledge": "k.md"}\n\n{"instance_id": "i2", "db": "d", "question": "no gold"}\n{"instance_id": "i3", "db": "d", "question": "q", "external_knowledge": null}')
    (lite / "sql/i1.sql").write_text(" SELECT 1 \n")
    (lite / "sql/i3.sql").write_text("SELECT 3")
    (lite / "md").mkdir()
    (lite / "md/k.md").write_text("note")
    rows = readers.spider2_lite(spark, str(lite / "lite.jsonl"), str(lite / "sql"), str(lite / "md")).orderBy("pos").collect()
    assert [(r["pos"], r["question"], r["evidence"]) for r in rows] == [(0, "do", "note"), (3, "q", None)]

    db = tmp_path / "dbs"
    db.mkdir()
    con = sqlite3.connect(db / "shop.sqlite")
    con.execute('create table "my t" (id integer primary key, n varchar(3) references o(x))')
    con.execute("create index ix on \"my t\" (n)")
    con.commit()
    con.close()
    cols = readers.sqlite_catalog(spark, str(db / "*.sqlite")).orderBy("position").collect()
    assert [(r["db"], r["name"], r["type"], r["is_pk"], r["references_table"]) for r in cols] == [("shop", "id", "INTEGER", True, None), ("shop", "n", "VARCHAR(3)", False, "o")] and "create index" in cols[0]["ddl"].lower()

    schemas = spark.createDataFrame([("Db", "t", None, 'CREATE TABLE t ("a b" TEXT,\n x INT)')], "db string, table_name string, description string, DDL string")
    sinks.write_schema_csv(schemas, str(tmp_path / "csv"))
    back = readers.schema_csv(spark, str(tmp_path / "csv/*/*.csv"))
    assert back.first()["DDL"] == schemas.first()["DDL"] and back.first()["description"] == ""
    inst = readers.get_dataset(spark, "spider", str(base))
    sinks.write_instances(inst, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    old, new = (spark.createDataFrame(r, "k long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    sinks.upsert(old, new, ["k"], str(tmp_path / "up"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "up")).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    manifest = sinks.write_features({"q": inst.select("id", "question")}, str(tmp_path / "f"))
    assert manifest.first()["total_instances"] == 5 and sinks.metadata(inst, "spider").first()["database_instance_counts"] == {"Db": 5}


def test_broken_schema_csv(spark, tmp_path):
    (tmp_path / "Db.csv").write_text(
        'table_name,description,DDL\n"good","a, b","CREATE TABLE good (x INT,\n y TEXT)"\n'
        "loose,of orders,CREATE TABLE loose (id INT, name TEXT, up INT)\nlost,one,two,three\nshort\n"
    )
    got = {r["table_name"]: r for r in readers.schema_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got["good"]["DDL"] == "CREATE TABLE good (x INT,\n y TEXT)" and got["good"]["description"] == "a, b"
    assert got["loose"]["DDL"] == "CREATE TABLE loose (id INT, name TEXT, up INT)" and got["loose"]["description"] == "of orders"
    assert got["lost"]["DDL"] == got["short"]["DDL"] == readers.MISSING_SCHEMA


def test_providers(spark):
    df = spark.createDataFrame([(1, "a", "Table: t1 x", "q"), (2, "a", "Table: t1 x", "r"), (3, "b", "none", None)], "id long, g string, intro string, prompt string")
    got = {r["id"]: r["raw_response"] for r in converse(df, EchoProvider, "g", "id", "intro").collect()}
    assert "FROM t1" in got[1] and "FROM t1" in got[2] and "FROM t\n" in got[3]

    class Broken:
        def generate(self, system, messages):
            raise OSError("down")

    assert {r["raw_response"] for r in generate(df, Broken, "s").collect()} == {"Model error: down"}
    v = df.select(hashed_embedding("intro").alias("v")).first()["v"]
    assert len(v) == 64 and sum(v) == 3


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    turns = spark.createDataFrame([(1, 0, "system", "s" * 8), (1, 1, "user", "a" * 40), (1, 2, "user", "b" * 8), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    run = live.live_history(stream, 6).writeStream.format("memory").queryName("hist").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["conv_id"], r["turn"]): (r["messages"], r["tokens"]) for r in spark.sql("select * from hist").collect()}
    assert got == {(1, 0): (0, 2), (1, 1): (0, 2), (1, 2): (1, 4), (2, 0): (1, 0)}
    live.save_batches(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_prompts(spark):
    row = spark.range(1).select(
        prompts.question_prompt(F.lit("q"), F.lit(None).cast("string")).alias("a"), prompts.question_prompt(F.lit("q"), F.lit("e")).alias("b"),
        prompts.available_tokens(F.lit("anthropic"), F.lit(99_990)).alias("c"), prompts.judge_verdict(F.lit("not equivalent")).alias("d"), prompts.judge_verdict(F.lit("hm")).alias("e"),
    ).first()
    assert tuple(row) == ("Question: q", "Question: q (PS : e)", 50, False, None)


def test_judge_words_end_at_other_letters(spark):
    texts = ["para no\u00f1bo", "ci\u00f1 no\u00f1os", "que yes\u00edosja", "\u00e9same", "no_te", "nota", "No."]
    said = spark.createDataFrame([(t,) for t in texts], "t string").select(prompts.judge_verdict(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in said] == [False, False, True, True, None, None, False]


def test_pipeline_choice(spark):
    base = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(20)], "vec_id long, embedding array<float>")
    out = spark.createDataFrame([(k, m, int((k < 10) == (m == "low"))) for k in range(20) for m in ("low", "high")], "vec_id long, model string, success int")
    chosen = process.choose_models(base.where("vec_id in (1, 18)").withColumnRenamed("vec_id", "input_id"), base, out, 3)
    assert {r["input_id"]: r["model"] for r in chosen.collect()} == {1: "low", 18: "high"}


def test_command_line_and_reports(spark, tmp_path, capsys):
    from sqlcurio.__main__ import main
    from sqlcurio.plans import reports

    (tmp_path / "dev.json").write_text(json.dumps([{"question_id": k, "db_id": f"d{k % 3}", "question": "How many more than 3?", "SQL": "SELECT count(*) FROM t", "evidence": "", "difficulty": "simple"} for k in range(30)]))
    for command in ("enrich", "profile", "subset"):
        main([command, "bird", str(tmp_path), "--out", str(tmp_path / command), "--target", "9"])
    assert spark.read.json(str(tmp_path / "enrich")).count() == 30 and spark.read.json(str(tmp_path / "subset")).count() == 9
    assert "original 30, selected 9" in capsys.readouterr().out
    rows = process.enrich(readers.get_dataset(spark, "bird", str(tmp_path)))
    frames = reports.charts(rows)
    assert {k: f.count() for k, f in frames.items()} == {"difficulty": 1, "lengths": 2, "joins": 1, "tables": 1, "linguistic": 5, "aggregates": 1, "clauses": 0}
    raw = readers.bird(spark, str(tmp_path))
    assert readers.example_at(raw, 4).first()["question_id"] == 4 and readers.example_at(raw, 99).count() == 0
    spark.createDataFrame([(k,) for k in range(9)], "a long").createOrReplaceTempView("t_sample")
    samples = readers.table_samples(spark, ["t_sample", "t_gone"])
    assert samples["t_sample"].count() == 5 and samples["t_gone"].count() == 0
    schemas = spark.createDataFrame([("D0", "t", "", "CREATE TABLE t (a INT)")], "schema_name string, table_name string, description string, DDL string")
    assert readers.schema_of(schemas, "d0").count() == 1 and readers.with_schema(rows, schemas).count() == 10
    predicted = process.predict(readers.with_schema(rows, schemas), EchoProvider)
    assert {r["generated_sql"] for r in predicted.collect()} == {"SELECT * FROM t"}


def test_http_provider_and_fallback(monkeypatch):
    import http.server
    import threading

    from sqlcurio.plans.providers import FallbackProvider, HttpProvider, answer_tokens

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers, body))
            out = {"choices": [{"message": {"content": "A"}}]} if self.path == "/chat" else {"content": [{"text": "B"}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("MODEL_API_KEY", "k")
    base = f"http://127.0.0.1:{server.server_port}"
    said = [{"role": "user", "content": "q"}]
    assert HttpProvider(f"{base}/chat", "m").generate("s", said) == "A" and seen[0][1]["messages"][0]["role"] == "system" and seen[0][0]["Authorization"] == "Bearer k"
    assert HttpProvider(f"{base}/messages", "m", "messages").generate("s", said) == "B" and seen[1][1]["system"] == "s"
    server.shutdown()
    server.server_close()
    assert FallbackProvider(HttpProvider(f"{base}/chat", "m", timeout=1), EchoProvider()).generate("", said).startswith("```sql")
    assert [answer_tokens(n) for n in (0, 30_000, 40_000)] == [1024, 500, 50]


def test_sqlite_views_and_processed_folder(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "shop.sqlite")
    con.execute("create table item (id integer, price real, name text)")
    con.executemany("insert into item values (?, ?, ?)", [(k, k / 2, None if k == 3 else f"n{k}") for k in range(9)])
    con.commit()
    con.close()
    glob = str(tmp_path / "*.sqlite")
    assert readers.register_sqlite(spark, glob, "shop") == ["item"]
    assert evaluate.check_execution(spark, "SELECT count(*), sum(price) FROM item WHERE name IS NOT NULL", "SELECT 8, 16.5D")[0]
    assert readers.sqlite_rows(spark, glob, 5).count() == 5
    for name, text in (("instances/a.json", {"id": 1}), ("schemas/dbx.json", {"tables": 2}), ("metadata.json", {"total": 1})):
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(json.dumps(text))
    got = readers.processed_dir(spark, str(tmp_path / "p"))
    assert got["instances"].count() == 1 and got["schemas"].first()["db_name"] == "dbx" and got["metadata"].first()["total"] == 1
    sinks.append_log(spark.createDataFrame([("m", "reply")], "model string, response string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first()["response_length"] == 5
    t = F.array(F.struct(F.lit("t").alias("table_name"), F.lit(None).cast("string").alias("description"), F.lit("d").alias("DDL")))
    assert spark.range(1).select(prompts.instance_text(F.lit("q"), F.lit(None).cast("string"), t)).first()[0] == "Question: q\nEvidence: \nTable: t Description:  DDL: d"


def test_catalog_keys_views_and_positions(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "two.sqlite")
    con.executescript("create table p (id integer); create table q (id integer); create table 'a b' (x integer references p(id) references q(id)); create table a_b (x integer); insert into 'a b' values (1); insert into a_b values (2), (3);")
    con.commit()
    con.close()
    glob = str(tmp_path / "*.sqlite")
    keys = readers.sqlite_catalog(spark, glob).where("table_name = 'a b'").collect()
    assert sorted(r["references_table"] for r in keys) == ["p", "q"]
    assert readers.register_sqlite(spark, glob, "two") == ["a b", "a_b", "p", "q"]
    assert spark.table("`a b`").columns == ["x"] and (spark.table("`a b`").count(), spark.table("a_b").count()) == (1, 2)

    for name, rows in (("one.json", [{"n": k} for k in range(5)]), ("two.json", []), ("three.json", [{"n": k, "m": 1} for k in range(5, 9)])):
        (tmp_path / name).write_text(json.dumps(rows))
    got = readers.json_array(spark, [str(tmp_path / x) for x in ("one.json", "three.json")], 7).collect()
    assert sorted((r["pos"], r["n"]) for r in got) == [(k, k) for k in range(7)]


def test_subset_input(spark, tmp_path):
    import gzip

    text = json.dumps({"instances": [{"id": 1, "db_id": "x"}, {"id": 2, "db_id": "y"}], "schemas": {"x": {"table_count": 3}, "y": {"table_count": 5}}})
    (tmp_path / "s.json").write_text(text)
    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        f.write(text)
    for name in ("s.json", "s.json.gz"):
        instances, schemas = readers.subset_input(spark, str(tmp_path / name))
        assert instances.count() == 2 and {tuple(r) for r in schemas.collect()} == {("x", 3), ("y", 5)}


def test_predictions_are_executed_in_a_plan(spark):
    from sqlcurio.plans import process

    spark.range(3).createOrReplaceTempView("numbers")
    tables = [("numbers", "", "CREATE TABLE numbers (id BIGINT)")] + [(f"t{k}", "", "x" * 9000) for k in range(4)]
    rows = [(1, "d", "small", "q1", None, "SELECT id FROM numbers", tables[:1]), (2, "d", "small", "q2", None, "SELECT id FROM numbers WHERE id > 0", tables[:1]), (3, "d", "large", "q3", None, "SELECT * FROM numbers", tables), (4, "d", "small", "q4", None, None, tables[:1])]
    df = spark.createDataFrame(rows, "id long, dataset string, db_id string, question string, evidence string, sql string, schema_tables array<struct<table_name: string, description: string, DDL: string>>")
    df = df.withColumn("database", F.struct(F.lit("sqlite").alias("type")))
    got = {r["id"]: r for r in process.predict_and_execute(df, EchoProvider).collect()}
    assert [got[k]["execution_correct"] for k in (1, 2, 3, 4)] == [True, False, True, None] and got[2]["execution_error"] == evaluate.OTHER_ROWS
    assert len(got[3]["introduction"]) > 1 and len(got[1]["introduction"]) == 1 and "part 1 of" in got[3]["introduction"][0]
    assert got[3]["exact_match"] and got[3]["semantic_equivalent"] and not got[2]["semantic_equivalent"]
