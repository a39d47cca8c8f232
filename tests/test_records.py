"""One file a record, copies beside it, nothing of failed runs."""

import json
from pathlib import Path

import pytest

from sqlcurio.sources import records


def frame(spark, tmp_path, n=40):
    for k in range(3):
        (tmp_path / f"s{k}.sql").write_text(f"select {k}")
    rows = [(f"a/{k % 30}", k, [str(tmp_path / f"s{j}.sql") for j in range(k % 4 and k % 3)]) for k in range(n)]
    return spark.createDataFrame(rows, "id string, k int, files array<string>").repartition(4)


def parts(out):
    return sorted(p for p in out.rglob("*.json"))


def test_records_and_copies_agree(spark, tmp_path):
    out = tmp_path / "out"
    df = frame(spark, tmp_path)
    records.write_records(df, str(out), "id", "files")
    found = {}
    for p in parts(out):
        r = json.loads(p.read_text())
        found[r["k"]] = r["id"]
        assert [(p.parent / f).read_text() for f in r["files"]] == [f"select {j}" for j in range(r["k"] % 4 and r["k"] % 3)]
        assert p.name.startswith("a_")
    assert found == {r["k"]: r["id"] for r in df.collect()}
    listed = [json.loads(line) for m in out.rglob("manifest.jsonl") for line in m.read_text().splitlines()]
    run = next(out.glob("run-*"))
    assert len(listed) == 40 and all((run / x["file"]).exists() for x in listed)
    done = json.loads((run / "_SUCCESS").read_text())
    assert done["records"] == 40 and done["files"] == sum(len(x["copies"]) for x in listed) and not list(out.glob("_staging*"))
    records.write_records(df.where("k < 5"), str(out), "id", mode="append")
    assert len(parts(out)) == 45 and len(list(out.glob("run-*"))) == 2
    records.write_records(df.where("k < 5"), str(out), "id")
    assert len(parts(out)) == 5 and len(list(out.glob("run-*"))) == 1
    records.write_records(df.limit(0), str(out), "id")
    assert parts(out) == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    df = frame(spark, tmp_path)
    records.write_records(df.where("k < 9"), str(out), "id")
    before = {p: p.read_text() for p in parts(out)}
    (tmp_path / "s1.sql").unlink()
    with pytest.raises(Exception, match="s1.sql"):
        records.write_records(df, str(out), "id", "files")
    assert {p: p.read_text() for p in parts(out)} == before and not list(out.glob("_staging*"))
    assert sorted(Path(p).name for p in out.iterdir()) == [next(out.glob("run-*")).name]
