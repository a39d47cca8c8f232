"""Conversations side by side give what one after another gives."""

import hashlib
import threading
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from sqlcurio.plans import dispatch, providers


def hashing():
    """A class of providers (made here so that it travels by value) whose answer depends on every message."""

    class Hashing:
        def __init__(self, wait=0.0):
            self.wait = wait

        def generate(self, system, messages):
            time.sleep(self.wait)
            return hashlib.md5(repr([(m["role"], m["content"]) for m in messages]).encode()).hexdigest()

    return Hashing


def questions(spark, conversations=12, turns=9):
    rows = [(f"c{k}", t, f"intro {k}" if k % 2 else None, None if t == 4 else f"q{t}") for k in range(conversations) for t in range(turns)]
    return spark.createDataFrame(rows, "key string, at long, intro string, prompt string").withColumn("intros", F.array(F.lit("a"), F.coalesce("intro", F.lit("b")))).repartition(3)


def test_side_by_side_equals_one_after_another(spark):
    Hashing = hashing()
    df = questions(spark)
    for introduction in ("intro", "intros"):
        one = providers.converse(df, Hashing, "key", "at", introduction, history=6)
        many = dispatch.converse_together(df, Hashing, "key", "at", introduction, history=6, at_once=5)
        assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
        placed = many.select(F.spark_partition_id().alias("p"), "key", "at").collect()
        for p in {r["p"] for r in placed}:
            own = [(r["key"], r["at"]) for r in placed if r["p"] == p]
            assert own == sorted(own)
    assert dispatch.converse_together(df.limit(0), Hashing, "key", "at", "intro").count() == 0


def test_throughput_grows_with_the_bound(spark):
    Hashing = hashing()
    df = questions(spark, 16, 4).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        took = {}
        for n in (1, 8):
            began = time.monotonic()
            dispatch.converse_together(df, lambda: Hashing(0.05), "key", "at", "intro", at_once=n).collect()
            took[n] = time.monotonic() - began
        assert took[8] < 0.6 * took[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_failures_are_retried_and_then_told(spark):
    Hashing = hashing()

    class Flaky(Hashing):
        def __init__(self):
            super().__init__()
            self.seen, self.lock = {}, threading.Lock()

        def generate(self, system, messages):
            with self.lock:
                n = self.seen[repr(messages)] = self.seen.get(repr(messages), 0) + 1
            if n < 3 or messages[-1]["content"] == "q7":
                raise OSError("busy")
            return super().generate(system, messages)

    df = questions(spark, 4).where("at < 7")
    got = dispatch.converse_together(df, Flaky, "key", "at", "intro", pause=0.001)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, providers.converse(df, Hashing, "key", "at", "intro").collect()), key=repr)
    told = dispatch.converse_together(questions(spark, 2).where("at >= 7"), Flaky, "key", "at", "intro", pause=0.001).collect()
    assert {r["raw_response"] for r in told if r["at"] == 7} == {"Model error: busy"} and all("error" not in r["raw_response"] for r in told if r["at"] == 8)


def test_threads_of_the_service_are_begun_once(spark):
    class Threads:
        def __init__(self):
            self.threads, self.lock = {}, threading.Lock()

        def begin(self, introduction):
            with self.lock:
                name = f"thread {len(self.threads)}"
                self.threads[name] = [*introduction]
            return name

        def ask(self, thread, text):
            self.threads[thread].append(text)
            return "|".join(self.threads[thread])

    out = dispatch.converse_together(questions(spark, 6, 3), Threads, "key", "at", "intros").collect()
    assert all(r["raw_response"] == "|".join([*r["intros"], *(f"q{t}" for t in range(r["at"] + 1))]) for r in out) and len(out) == 18


def test_the_bucket_holds_its_rate():
    now, slept = [0.0], []
    bucket = dispatch.TokenBucket(2.0, 3, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(9):
        bucket.take()
    assert abs(now[0] - 3.0) < 1e-9 and len(slept) == 6
    now[0] += 100
    slept.clear()
    for _ in range(3):
        bucket.take()
    assert not slept


def test_columns_beside_a_conversation_go_by_unread(spark):
    Hashing = hashing()
    df = spark.createDataFrame([("a", k, "intro", f"q{k}", n) for k, n in enumerate([2**53 + 1, None, 7])], "key string, at long, intro string, prompt string, n long")
    one = providers.converse(df, Hashing, "key", "at", "intro")
    many = dispatch.converse_together(df, Hashing, "key", "at", "intro")
    for got in (one, many):  # as floating point numbers beside a null they would be rounded
        assert [r["n"] for r in got.orderBy("at").collect()] == [2**53 + 1, None, 7]
    again = dispatch.converse_together(many.withColumn("raw_response", F.lit("old")), Hashing, "key", "at", "intro")
    assert again.columns == many.columns and sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)


def test_a_batch_of_one_conversation_is_one_future(spark):
    Hashing = hashing()
    talk, asked = dispatch.Conversation(Hashing(), dispatch.Patient(1, 0, None), "intro", 6), [f"q{k}" for k in range(5)]
    with ThreadPoolExecutor(1) as workers:
        together = talk.ask(asked[:3], workers).result() + talk.ask(asked[3:], workers).result()
        alone = dispatch.Conversation(Hashing(), dispatch.Patient(1, 0, None), "intro", 6)
        assert together == [alone.ask([q], workers).result()[0] for q in asked]
