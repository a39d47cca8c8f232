"""SQLite tables read in ranges, with filters and columns left to the database."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sqlcurio.operators import execute
from sqlcurio.sources import sqlite


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "shop one.sqlite")
    con, draw = sqlite3.connect(path), random.Random(3)
    con.execute('create table item (id integer primary key, name text, price real, "odd ""name" varchar(9), raw blob, loose)')
    con.executemany("insert into item values (?, ?, ?, ?, ?, ?)", [(k * 3, draw.choice(["ab", "Äc", "b'd", None, ""]), draw.choice([None, k / 4]), str(k), bytes([k % 256]), draw.choice([k, k / 2, "x", None, b"y"])) for k in range(2000)])
    con.execute("insert into item values (99999, 'stray', 'not a number', 5, 'text', 1)")
    con.execute("create table plain (a text primary key, n int) without rowid")
    con.executemany("insert into plain values (?, ?)", [(f"k{k}", "oops" if k == 3 else k) for k in range(20)])
    con.execute("create view cheap as select id, price from item where price < 10")
    con.execute("create table empty (a int)")
    con.commit()
    con.close()
    return path


def test_ranges_are_tasks_and_all_rows_come_once(spark, shop):
    df = sqlite.sqlite_table(spark, shop, "item", rows_per_task=1000)
    assert df.rdd.getNumPartitions() > 5
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "string", "binary", "string"]
    assert df.count() == 2001 and df.select("id").distinct().count() == 2001
    stray = df.where("id = 99999").first()
    assert (stray["price"], stray['odd "name'], stray["raw"]) == (None, "5", bytearray(b"text"))


@pytest.mark.parametrize("where", [
    "id = 30", "id in (3, 6, 7)", "id > 5900", "id between 30 and 60", "price >= 400.5", "price is null", "price is not null and id < 100", "name = 'ab'", "name <=> 'Äc'", "name is null", "name > 'ab'", "name like 'b%'",
    "`odd \"name` = '7'", "loose = '5'", "loose = 'x'", "loose = 'y'", "name = 'b\\'d' or id = 3", "id % 7 = 0", "raw = X'05'", "not (name = 'ab')",
])
def test_filters_give_what_spark_alone_gives(spark, shop, where):
    df = sqlite.sqlite_table(spark, shop, "item", rows_per_task=2500)
    alone = spark.createDataFrame(df.collect(), df.schema)
    assert sorted(map(repr, df.where(where).collect())) == sorted(map(repr, alone.where(where).collect()))


def test_filters_and_columns_reach_the_database(spark, shop):
    reader = sqlite.SqliteReader({"path": shop, "table": "item"}, sqlite.SqliteSource({"path": shop, "table": "item", "columns": '["id", "name"]'}).schema())
    kept = list(reader.pushFilters([sqlite.GreaterThan(("id",), 5900), sqlite.EqualTo(("name",), "ab")]))
    assert len(kept) == 2 and reader.where == ['"id" > ?', 'CAST("name" AS TEXT) = ?']
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(b.schema.names == ["id", "name"] for b in batches) and 0 < sum(b.num_rows for b in batches) < 100
    narrow = sqlite.sqlite_table(spark, shop, "item", ["price", "id"]).where("id < 30")
    assert narrow.columns == ["price", "id"] and narrow.count() == 10
    with pytest.raises(Exception, match="no columns"):
        sqlite.sqlite_table(spark, shop, "item", ["nope"])
    with pytest.raises(Exception, match="no table"):
        sqlite.sqlite_table(spark, shop, "nope")


def test_shipped_files_and_statements_over_a_database(spark, shop):
    assert sqlite.sqlite_table(spark, shop, "plain", ship=True).where("n >= 10").count() == 10
    assert sqlite.sqlite_table(spark, "file://" + shop, "plain").where("n is null").count() == 1
    assert sqlite.connect_database(spark, shop) == ["cheap", "empty", "item", "plain"]
    assert spark.table("empty").count() == 0 and spark.table("cheap").agg(F.max("price")).first()[0] < 10
    said = spark.createDataFrame([("SELECT count(*) FROM item WHERE price < 10", "SELECT count(price) FROM cheap"), ("SELECT a FROM plain", "SELECT a FROM plain WHERE n > 3")], "sql string, generated_sql string")
    assert {r["sql"]: r["execution_correct"] for r in execute.check_executions(said).collect()} == {"SELECT count(*) FROM item WHERE price < 10": True, "SELECT a FROM plain": False}
