"""The preceding messages of a channel on a stream, so that detectors run on live messages."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmura import constants as C

ENTRY = "message_id bigint, author_id string, content string"
FIELDS = ["event_kind", "server_id", "channel_id", "message_id", "ts", "author_id", "is_bot", "is_webhook", "channel_type", "content"]
OUTPUT = (
    "event_kind string, server_id string, channel_id string, message_id bigint, ts timestamp, author_id string, is_bot boolean, is_webhook boolean, channel_type string, content string, "
    "history array<struct<message_id: bigint, author_id: string, content: string>>"
)


class HistoryProcessor(StatefulProcessor):
    """Keeps a channel's newest messages and hands them to each that follows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = deque((tuple(r) for r in self.last.get()), C.MAX_DEPTH) if self.last.exists() else deque(maxlen=C.MAX_DEPTH)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "message_id"], kind="stable")
        out = []
        for r in batch[FIELDS].itertuples(index=False):
            out.append((*r, [{"message_id": m, "author_id": a, "content": c} for m, a, c in kept]))
            kept.append((int(r.message_id), r.author_id, r.content))
        self.last.put(list(kept))
        yield pd.DataFrame(out, columns=[*FIELDS, "history"])

    def close(self) -> None:
        pass


def with_history_stream(messages: DataFrame) -> DataFrame:
    """A stream of messages with ``history`` as ``operators.context.with_history`` gives it.

    All rows of a channel enter its history, also bots' and webhooks'; filter
    afterwards.  Needs the RocksDB state store.
    """
    return messages.select(*FIELDS).groupBy("server_id", "channel_id").transformWithStateInPandas(
        statefulProcessor=HistoryProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
