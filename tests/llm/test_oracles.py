"""Each operator that SQL can express against its DuckDB twin, on the smallest tables and on awkward rows."""

import duckdb
import pytest

from sqlcurio.llm import queries

SF = "/root/testdata/sf0.001"
DOCUMENTS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", "de", None), (4, "é" * 130 + " x", "de", None), (5, "é" * 120, None, "b"), (6, "x " * 40_000, "en", "b"), (7, "one two", "en", "c"), (8, "one two", "en", "c"),
    (9, "ab" * 300, "fr", "d"), (-3, "zero " * 50, "fr", "d"), *[(100 + k, f"word {k} " * (k % 9), "en", "abcd"[k % 4]) for k in range(400)],
]


def same(spark, folder, tables, name, pattern=""):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{pattern}')")
    out = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in out.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(df.columns)
    tidy = lambda rows, names: sorted((tuple(round(v, 6) if isinstance(v := r[names.index(c)], float) else v for c in sorted(names)) for r in rows), key=repr)
    assert tidy(df.collect(), df.columns) == tidy(out.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_given_tables(spark, name):
    same(spark, SF, ["documents", "pages", "benchmark", "labels", "embeddings"], name)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op9_urlrules"}))
@pytest.mark.parametrize("rows", [DOCUMENTS, DOCUMENTS[:3], []])
def test_awkward_documents(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], k % 3 and k % 2, k % 5 == 0 and 1 or None) for k, r in enumerate(rows)] + [(1, 0, 1), (None, 1, 1), (999_999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [] if not rows else [(k, [((k * 7 + d * 5) % 11 - 5) / 7 for d in range(6)], k % 4) for k in range(120)]
    vectors += [(200, None, 1), (250, [1.0] * 6, None), (300, [float("nan")] + [1.0] * 5, 1), (350, [float("inf")] + [1.0] * 5, 1), (400, [None] + [1.0] * 5, 1), (450, [0.0] * 6, 2), (500, [-0.5] * 6, 1), (550, [5000.0] * 6, 3)] * bool(rows)
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, str(tmp_path), ["documents", "labels", "embeddings"], name, "/*.parquet")
