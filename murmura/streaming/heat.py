"""Channel heat on a stream: the fold of ``operators.folds`` with state per channel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmura.operators.folds import ChannelState

OUTPUT = "server_id string, channel_id string, message_id bigint, ts timestamp, heat double, average double, samples int, ring_mean double, hot boolean, alert boolean"
STATE = "average double, ring array<double>, alerted bigint"


class HeatProcessor(StatefulProcessor):
    """Keeps a channel's average, its last averages and its last alert."""

    def __init__(self, cooldown: int = 60):
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("heat", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        state = ChannelState(*old) if old else ChannelState()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "message_id"], kind="stable")
        out = []
        for r in batch.itertuples(index=False):
            micros = int(pd.Timestamp(r.ts).value // 1000)
            out.append((key[0], key[1], r.message_id, r.ts, r.heat, *state.push(r.heat, micros, self.cooldown)))
        self.state.update((state.average, list(state.ring), state.alerted))
        yield pd.DataFrame(out, columns=["server_id", "channel_id", "message_id", "ts", "heat", "average", "samples", "ring_mean", "hot", "alert"])

    def close(self) -> None:
        pass


def channel_heat_stream(events: DataFrame, cooldown: int = 60) -> DataFrame:
    """Averages and alerts of a stream of ``(server_id, channel_id, message_id, ts, heat)``.

    Rows are ordered by ``(ts, message_id)`` within a batch; across batches, in
    order of arrival.  Needs the RocksDB state store.
    """
    return events.groupBy("server_id", "channel_id").transformWithStateInPandas(
        statefulProcessor=HeatProcessor(cooldown), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def member_stats_stream(events: DataFrame, keys: tuple[str, ...] = ("server_id", "author_id")) -> DataFrame:
    """The members' statistics of a stream, for output mode ``complete`` or ``update``."""
    from murmura.operators.stats import member_stats

    return member_stats(events, list(keys))


def save_snapshots(stats: DataFrame, path: str, checkpoint: str, minutes: int = 5):
    """Starts a query that rewrites the statistics every few minutes; intervals of 0 or less mean 5."""
    every = minutes if minutes > 0 else 5

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").json(path)

    return stats.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} minutes").start()


def live_messages(spark, path: str, schema: str) -> DataFrame:
    """A stream of messages, edits or reactions from a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def admitted(stream: DataFrame) -> DataFrame:
    """New messages and edits that are to be scored; edits have no webhook rule."""
    message = (F.col("event_kind") == "message") & ~F.col("is_webhook")
    return stream.where(~F.col("is_bot") & (F.col("channel_type") == "TEXT") & (message | (F.col("event_kind") == "edit")))
