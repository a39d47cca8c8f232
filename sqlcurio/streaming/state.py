"""Conversations in keyed state that grows by message and expires; keyed tables that streams bring up to date."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sqlcurio.operators.profile import first_per_key
from sqlcurio.operators.shared import written

#: The state store that lists and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class History(StatefulProcessor):
    """Sizes of a conversation's fitting messages: new ones are appended, those that left are skipped until half have.

    Only then is the list written anew, so what is written for a message is a constant, not its history.
    Texts are not kept. A conversation without a message for ``idle_ms`` leaves the state.
    """

    def __init__(self, budget: int, idle_ms: int | None) -> None:
        self.budget, self.idle_ms = budget, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sizes = handle.getListState("sizes", "tokens long")
        self.totals = handle.getValueState("totals", "system long, used long, gone long, listed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, system_, tokens = (np.concatenate(x) for x in zip(*((b["turn"].to_numpy(), (b["role"] == "system").to_numpy(), (b["text"].str.len().fillna(0) // 4).to_numpy(np.int64)) for b in rows), strict=True))
        system, used, gone, listed = map(int, self.totals.get()) if self.totals.exists() else (0, 0, 0, 0)
        kept = [int(t[0]) for t in self.sizes.get()][gone:] if listed else []
        new, out, first = [], [], 0
        for k in np.argsort(turns, kind="stable"):
            if system_[k]:
                system += int(tokens[k])
            else:
                new.append(int(tokens[k]))
                used += int(tokens[k])
            while system + used > self.budget and first < len(kept) + len(new):
                used -= kept[first] if first < len(kept) else new[first - len(kept)]
                first += 1
            out.append((key[0], int(turns[k]), len(kept) + len(new) - first, system + used))
        gone, listed = gone + first, listed + len(new)
        if 2 * gone > listed:
            left = [(t,) for t in [*kept, *new][first:]]
            self.sizes.put(left) if left else self.sizes.clear()
            gone, listed = 0, len(left)
        elif new:
            self.sizes.appendList([(t,) for t in new])
        self.totals.update((system, used, gone, listed))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "messages", "tokens"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sizes.clear()
        self.totals.clear()
        yield pd.DataFrame({"conv_id": pd.Series(dtype="int64"), "turn": pd.Series(dtype="int64"), "messages": pd.Series(dtype="int64"), "tokens": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def conversation_state(turns: DataFrame, budget: int, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, turn, messages, tokens) for each arriving turn (conv_id, turn, role, text): what of the history fits.

    As :func:`live.live_history`, but state is written by message, not anew with each batch, and
    conversations idle for ``idle_ms`` expire; a message after that starts a conversation anew. Timers
    need a stream that goes on: with the trigger ``availableNow`` a stream that has some doesn't end.
    Needs the state store ``STORE``, which is set for the session. Rows of null conversations are one.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return turns.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=History(budget, idle_ms), outputStructType="conv_id long, turn long, messages long, tokens long", outputMode="append", timeMode="None" if idle_ms is None else "ProcessingTime"
    )


def upsert_into(path: str, keys: list[str], order: str, name: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: rows of a batch replace those of their keys in the table below ``path``.

    The table is parted by a hash of the keys; only parts that a batch touches are read and written, the
    files of the others stay. Of rows with one key the last by ``order`` counts. What a batch did is a
    row of the ledger, by ``name`` (of the stream) and number: a batch that is there changes nothing. A
    run that ends between the two is repeated with the same result, as the same rows win again.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = f"{path}/_ledger/{name}-{number}"
        where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(where):
            return
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("_age", F.lit(0))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # numbers below ``buckets``
        if touched:
            both = new
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")):
                old = spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(touched)).withColumn("_age", F.lit(1))
                both = new.unionByName(old, allowMissingColumns=True)
            merged = written(first_per_key(both, keys, [F.desc(order), F.col("_age")]).drop("_age"), "upsert")
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
        spark.createDataFrame([(name, number, len(touched))], "name string, batch long, parts int").coalesce(1).write.mode("overwrite").json(ledger)

    return save


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the table below ``path`` up to date with a stream; a checkpoint's batches are known by its path."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return stream.writeStream.foreachBatch(upsert_into(path, keys, order, name, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
