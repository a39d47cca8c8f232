"""Streams: bounded conversation histories and incremental keyed saves."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_history(turns: DataFrame, budget: int) -> DataFrame:
    """For each arriving turn (conv_id, turn, role, text): messages and tokens of the history that then fits.

    State is the sizes of the fitting messages only: system messages stay, the oldest others leave.
    Turns of one batch are taken in their order.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        system, sizes = state.get if state.exists else (0, [])
        sizes, used = deque(sizes), sum(sizes)
        turns = pd.concat([b[["turn", "role", "text"]] for b in batches]).sort_values("turn", kind="stable")
        own = turns["text"].str.len().fillna(0).astype("int64") // 4
        rows = []
        for turn, role, size in zip(turns["turn"].tolist(), turns["role"].tolist(), own.tolist(), strict=True):
            if role == "system":
                system += size
            else:
                sizes.append(size)
                used += size
            while sizes and system + used > budget:
                used -= sizes.popleft()
            rows.append((key[0], turn, len(sizes), system + used))
        state.update((system, list(sizes)))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "messages", "tokens"])

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turn long, messages long, tokens long", "system long, sizes array<long>", "append", GroupStateTimeout.NoTimeout)


def save_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Arriving instances appended as Parquet exactly once, each trigger a batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
