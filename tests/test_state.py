"""Conversation state over restarts and expiry; keyed tables brought up to date by streams."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from sqlcurio.streaming import state

TURNS = "conv_id long, turn long, role string, text string"


def truth(turns, budget):
    out, system, sizes = [], 0, []
    for conv, turn, role, text in turns:
        size = len(text or "") // 4
        if role == "system":
            system += size
        else:
            sizes.append(size)
        while sizes and system + sum(sizes) > budget:
            sizes.pop(0)
        out.append((conv, turn, len(sizes), system + sum(sizes)))
    return out


def run(spark, source, checkpoint, table):
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).json(source)
    q = state.conversation_state(stream, 60).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(100)


def test_histories_go_on_after_restarts(spark, tmp_path):
    draw = random.Random(8)
    turns = [(c, t, draw.choice(["user", "assistant", "system"] if t == 0 else ["user", "assistant"]), draw.choice([None, "x" * draw.randrange(90)])) for c in range(4) for t in range(30)]
    source, (checkpoint, table) = tmp_path / "in", (str(tmp_path / d) for d in ("check", "out"))
    source.mkdir()
    for part in range(3):  # a run each, two batches in the first
        for half in range(2 if part == 0 else 1):
            own = [r for r in turns if part * 10 + half * 5 <= r[1] < part * 10 + (5 if part == 0 and half == 0 else 10)]
            draw.shuffle(own)
            spark.createDataFrame(own, TURNS).coalesce(1).write.json(str(tmp_path / "part"), mode="overwrite")
            next((tmp_path / "part").glob("*.json")).rename(source / f"{part}-{half}.json")
        run(spark, str(source), checkpoint, table)
    got = sorted(map(tuple, spark.read.parquet(table).collect()))
    assert got == sorted(x for c in range(4) for x in truth([r for r in turns if r[0] == c], 60))


def test_idle_conversations_expire(spark, tmp_path):
    source, table, deadline = tmp_path / "in", str(tmp_path / "out"), time.monotonic() + 100
    source.mkdir()

    def arrive(conv, turn):
        spark.createDataFrame([(conv, turn, "user", "x" * 40)], TURNS).coalesce(1).write.json(str(tmp_path / f"part{turn}"))
        next((tmp_path / f"part{turn}").glob("*.json")).rename(source / f"{turn}.json")

    def wait(n):
        while time.monotonic() < deadline:
            if list(Path(table).glob("*.parquet")) and spark.read.parquet(table).count() >= n:
                return
            time.sleep(0.5)
        raise AssertionError("no rows in time")

    arrive(1, 0)
    stream = state.conversation_state(spark.readStream.schema(TURNS).json(str(source)), 60, idle_ms=1)
    q = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        wait(1)
        seen = q.lastProgress["batchId"]
        while q.lastProgress["batchId"] < seen + 4 and time.monotonic() < deadline:
            time.sleep(0.2)
        arrive(1, 1)
        wait(2)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, 0, 1, 10), (1, 1, 1, 10)]


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upserts_touch_only_their_parts_and_replays_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "id long, at long, v array<double>"
    save = state.upsert_into(path, ["id"], "at", "s", buckets=16)
    frame = lambda ids, at: spark.createDataFrame([(i, at, [float(at)]) for i in ids], schema)
    save(frame(range(100), 1), 0)
    before = files(path)
    save(frame([3, 200], 2).unionAll(frame([3], 1)), 1)
    after = files(path)
    assert len(set(before) & set(after)) >= 14 and all(after[p] == before[p] for p in set(before) & set(after))
    read = lambda: {r["id"]: r["at"] for r in spark.read.parquet(f"{path}/rows").collect()}
    want = {i: 1 for i in range(100)} | {3: 2, 200: 2}
    assert read() == want and spark.read.parquet(f"{path}/rows").count() == 101
    save(frame(range(100), 9), 0)  # replayed
    assert files(path) == after and read() == want
    save(frame([3], 1), 2)  # older than what is there
    save(frame([], 5), 3)
    assert read() == want
    assert spark.read.json(f"{path}/_ledger/*").agg(F.count("*"), F.max("batch")).first()[:] == (4, 3)


def test_upsert_streams_go_on_from_their_checkpoint(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    for k in range(2):
        spark.createDataFrame([(i, k, f"v{k}") for i in range(k, 5 + k)], "id long, at long, v string").write.json(str(source), mode="append")
        stream = spark.readStream.schema("id long, at long, v string").json(str(source))
        assert state.upsert_stream(stream, path, checkpoint, ["id"], "at").awaitTermination(120)
    assert {r["id"]: r["v"] for r in spark.read.parquet(f"{path}/rows").collect()} == {0: "v0"} | {i: "v1" for i in range(1, 6)}
