"""The registry's latest rows as the state of a stream.

Events are keyed by folder; the state of a key is its latest row by ``order``,
whose first column is the event time. A micro-batch emits the keys whose latest
row changed. The watermark bounds the state: a key is forgotten once the
watermark has passed its row, for whatever may still arrive in time is newer
than that row; rows behind the watermark are dropped as late. What is emitted
goes to ``sink``, for example a merge into the stored snapshot, which is
idempotent: a replayed micro-batch or a restart changes nothing.
"""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_by_state(events: DataFrame, key: str, order: list[str], delay: str) -> DataFrame:
    """Changed keys with their latest row; ``order[0]`` is the event time."""
    columns = events.columns
    at = [columns.index(c) for c in order]
    schema = T.StructType(list(events.schema.fields))

    def update(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        best = tuple(state.get) if state.exists else None
        before = best
        for pdf in frames:
            for row in pdf[columns].astype(object).where(pdf[columns].notna(), None).itertuples(index=False, name=None):
                if best is None or tuple(row[i] for i in at) > tuple(best[i] for i in at):
                    best = row
        moment = pd.Timestamp(best[at[0]])
        moment = moment.tz_localize("UTC") if moment.tzinfo is None else moment
        state.update(best)
        state.setTimeoutTimestamp(max(int(moment.timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        if best != before:
            yield pd.DataFrame([best], columns=columns)

    return events.withWatermark(order[0], delay).groupBy(key).applyInPandasWithState(
        update, schema, schema, "update", GroupStateTimeout.EventTimeTimeout)


def start_registry_state(events: DataFrame, key: str, order: list[str], delay: str, sink: Callable[[DataFrame, int], None],
                         checkpoint: str, available_now: bool = True):
    """Run the state over a stream of events; ``sink`` gets each micro-batch of
    changed keys."""
    w = (latest_by_state(events, key, order, delay).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
