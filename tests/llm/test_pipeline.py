"""Each stage of the pipeline against its operator, or brute force, on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from sqlcurio.llm import common, decontaminate, langid, mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.materialise(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}

    before, after = kept["language"]
    known = langid.identify(before).where("lang_pred <> 'und' and score >= 0.5").select("doc_id").collect()
    assert set(texts(after)) == {r[0] for r in known} and len(known) > 0.95 * before.count()

    before, after = kept["near_duplicates"]
    old = texts(before)
    fps, ids, root = {i: simhash.fingerprint(t) for i, t in old.items()}, sorted(old), {i: i for i in old}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(texts(after)) == {i for i in ids if find(i) == i}

    before, after = kept["decontamination"]
    items = [decontaminate.normal(r["text"]).decode() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    old, new = texts(before), texts(after)
    exact = {i for i, t in old.items() if any(x in decontaminate.normal(t).decode() for x in items)}
    gone = set(old) - set(new)
    assert exact <= gone
    for i in gone:
        t = decontaminate.normal(old[i]).decode()
        assert any(decontaminate.best_edit(x, t)[0] <= 0.2 * len(x) for x in items)

    before, after = kept["mixing"]
    plan = {r["doc_id"]: r for r in mixing.mix(before).collect()}
    assert len(plan) == before.count()
    copies = Counter(r["doc_id"] for r in after.select("doc_id").collect())
    for i, r in plan.items():
        assert r["taken"] // max(1, r["size"]) <= copies[i] <= -(-r["taken"] // max(1, r["size"]))
    words = sum(plan[i]["size"] * n for i, n in copies.items())
    assert abs(words - sum(r["taken"] for r in plan.values())) < 0.15 * words

    before, after = kept["sharding"]
    sizes = Counter(r["shard"] for r in after.collect())
    assert after.count() == before.count() and max(sizes.values()) - min(sizes.values()) <= 1


def test_run_and_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", "b", 1), (4, "x " * 50_000, "en", "a", 2), (5, "plain words of a clean text", "en", "a", 3), (5, "plain words of a clean text", "en", "a", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _copies string"
    for name, part in (("full", rows), ("none", [])):
        spark.createDataFrame([(*r, "extra") for r in part], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, "another text altogether")][: len(part)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {r["doc_id"] for r in got} <= {None, 4, 5} and corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, "some words here for all", "en", "b", 1), (None, "some words here for all", "en", "b", 1), (None, "and other words than those before", None, None, 1),
    (4, "x " * 50_000, "en", "a", 2), (5, "plain words of a clean text", "en", "a", 3), (5, "plain words of a clean text", "en", "a", 3), (5, "another text of the same number", "en", "a", 3), (6, "12 34 !!", "de", "b", 8), (7, "This IS the  item of a test", "en", "b", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _copies string, key string, _row string, _number int"


def stage(spark, tmp_path, name, rows):
    spark.createDataFrame([(0, "the item of a test"), (1, None), (2, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, "extra", "k", "r", 9) for r in rows], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    return out.columns, [tuple(r) for r in out.collect()]


def test_edges_of_each_stage(spark, tmp_path):
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, tmp_path, name, [])[1] == []
    every = Counter(EDGES)

    columns, got = stage(spark, tmp_path, "language", EDGES)
    assert columns == corpus_pipeline.COLUMNS and set(got) <= set(every) and all(Counter(got)[r] == every[r] for r in set(got))
    assert {r[0] for r in got} >= {5, 7} and not {r[0] for r in got} & {1, 2, 3, 6}

    columns, got = stage(spark, tmp_path, "near_duplicates", EDGES)
    assert columns == corpus_pipeline.COLUMNS and max(Counter(got).values()) == 1
    assert {r[1] for r in got} == {r[1] for r in EDGES[3:] if r[0] != 6} | {"12 34 !!"} | {None}  # null, empty and blank are one group

    columns, got = stage(spark, tmp_path, "decontamination", EDGES)
    assert columns == corpus_pipeline.COLUMNS and Counter(got) == Counter(r for r in EDGES if r[0] != 7)

    columns, got = stage(spark, tmp_path, "mixing", EDGES)
    assert columns == corpus_pipeline.COLUMNS and set(got) <= set(every) and not {r[0] for r in got} & {1, 2, 3}
    assert all(n <= 2 * every[r] for r, n in Counter(got).items())

    columns, got = stage(spark, tmp_path, "sharding", EDGES)
    assert Counter(r[0] for r in got) == Counter(r[0] for r in EDGES) and len({(r[columns.index("shard")], r[columns.index("slot")]) for r in got}) == len(EDGES)


def test_what_a_stage_has_read_is_deleted(spark, tmp_path):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = corpus_pipeline.run(spark, SF)
    assert docs.count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "pipeline-mixing" in left and left <= {"pipeline-mixing", "shard-slim", "shard-cells"}
