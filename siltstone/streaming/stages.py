"""Checkpoints as a stream: each item's stage is state that outlives batches and restarts.

The stream's state store is RocksDB, whose changes are committed with each micro-batch, so a query that is started again
with its checkpoint goes on where it was. A batch's events of one item are put in order before they meet the state; later
batches are taken to hold later events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Stages that end a workflow; no checkpoint may record them (fixed values of the journal format).
TERMINAL = ("terminal-success", "terminal-failure")
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StageMoves(StatefulProcessor):
    """State of an item: the highest rank so far, and how many checkpoints were taken."""

    def __init__(self, key: str, order: list[str], ranks: dict[str, int], carry: list[str]):
        self.key, self.order, self.ranks, self.carry = key, order, ranks, carry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stage", "rank long, checkpoints long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        best, taken = self.state.get() if self.state.exists() else (-1, 0)
        refused = events["stage"].isin(TERMINAL).to_numpy()
        known = events["stage"].map(self.ranks)
        rank = np.where(refused | known.isna(), -1, known.fillna(-1)).astype(np.int64)
        after = np.maximum.accumulate(np.concatenate(([best], rank)))
        best_before = after[:-1]
        kept = ~refused
        counts = taken + np.cumsum(kept)
        self.state.update((int(after[-1]), int(counts[-1])))
        yield events[self.carry].assign(
            **{self.key: key[0], "rank": best_before.clip(rank), "checkpoints": counts, "advanced": kept & (rank > best_before), "regressed": kept & (rank < best_before), "refused": refused}
        )[[self.key, *self.carry, "rank", "checkpoints", "advanced", "regressed", "refused"]]

    def close(self) -> None:
        pass


def stage_moves(stream: DataFrame, key: str, order: list[str], ranks: dict[str, int], carry: list[str]) -> DataFrame:
    """``key, <carry>, rank, checkpoints, advanced, regressed, refused`` of each event (``key, stage, <order>, <carry>``).

    ``rank`` is the item's highest stage after the event, ``checkpoints`` how many it has. A terminal stage is refused: it moves nothing
    and counts for nothing. A stage without a rank moves nothing.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    fields = dict(stream.dtypes)
    schema = ", ".join([f"`{key}` {fields[key]}", *(f"`{c}` {fields[c]}" for c in carry), "rank long, checkpoints long, advanced boolean, regressed boolean, refused boolean"])
    wanted = stream.select(key, "stage", *dict.fromkeys([*order, *carry]))
    return wanted.groupBy(key).transformWithStateInPandas(StageMoves(key, order, ranks, carry), outputStructType=schema, outputMode="Append", timeMode="None")
