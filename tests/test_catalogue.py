"""Every catalogue query against its DuckDB twin on the smallest tables."""

import os
import zlib

import duckdb
import pytest
import xxhash

from sqlcurio.plans import catalogue, duck
from sqlcurio.plans.providers import hashed_embedding

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def value(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in catalogue.ORACLES:
        out = db.execute(catalogue.ORACLES[name])
        columns = [c[0] for c in out.description]
        assert sorted(columns) == sorted(df.columns)
        want = out.fetchall()
        mine, theirs = rows_of(df.columns, got), rows_of(columns, want)
        assert mine == theirs
        kinds = lambda rows: [{type(v) for v in c} - {type(None)} for c in zip(*rows, strict=True)]
        assert kinds(mine) == kinds(theirs)


def test_hashes_in_sql():
    texts = ["", "a", "abc", "abcd", "abcdefg", "abcdefgh", "x" * 31, "y" * 32, "é" * 33, "long " * 500]
    con = duckdb.connect()
    con.execute("create table t (id bigint, s varchar)")
    con.executemany("insert into t values (?, ?)", [(k - 3, s) for k, s in enumerate(texts)])
    digits = "SELECT id, hex(encode(s)) AS x FROM t"
    found = con.execute(f"WITH src AS ({digits}), {duck.xxh64_sql('src', 'hashed')} SELECT id, h FROM hashed ORDER BY id").fetchall()
    assert [h for _, h in found] == [xxhash.xxh64_intdigest(s.encode(), 42) for s in texts]
    sums = con.execute(f"SELECT {duck.crc32_sql('x')} FROM ({digits}) ORDER BY id").fetchall()
    assert [c for (c,) in sums] == [zlib.crc32(s.encode()) for s in texts]
    found = con.execute(f"WITH src AS (SELECT id, {duck.long_digits('id')} AS x FROM t), {duck.xxh64_sql('src', 'hashed')} SELECT id, h FROM hashed").fetchall()
    assert all(h == xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42) for k, h in found)


def test_analysed_rows_are_dealt(spark):
    for rows in (catalogue.questions(spark, SF), catalogue.instances(spark, SF)):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_words_are_hashed_once_a_row(spark):
    rows = spark.createDataFrame([("one two two",), (None,)], "text string")
    plan = rows.select(hashed_embedding(dims=8))._jdf.queryExecution().analyzed().toString()
    assert plan.index("xxhash64") < plan.index("sequence")  # not within the lambda over the places
    counts = [0.0] * 8
    for w in (b"one", b"two", b"two"):
        counts[xxhash.xxh64_intdigest(w, 42) % 8] += 1
    assert [r["v"] for r in rows.select(hashed_embedding(dims=8).alias("v")).collect()] == [counts, [0.0] * 8]
