"""The live plan: a stream of messages becomes a stream of actions, statistics and monitor tables.

History is state per channel, the infraction level is state per member; the
detectors and what follows from a violation are those of the batch plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from murmura.functions.scores import reaction_affection
from murmura.operators import context, moderation, monitor, stats
from murmura.plans.moderate import phases
from murmura.streaming.history import FIELDS, with_history_stream


class LevelProcessor(StatefulProcessor):
    """Keeps a member's infraction level; each detection gets the level before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level = self.level.get()[0] if self.level.exists() else 0
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "message_id"], kind="stable", ignore_index=True)
        before = level + batch["punished"].cumsum() - batch["punished"]
        self.level.update((int(level + batch["punished"].sum()),))
        yield batch.assign(level_before=before.astype("int64"))

    def close(self) -> None:
        pass


def judged_stream(messages: DataFrame, configs: DataFrame) -> DataFrame:
    """Detections of a stream of messages and edits with their consequences, as ``plans.moderate.judged`` gives them.

    ``configs`` is a table.  Rows of a micro-batch are taken in order of time and
    id, micro-batches in order of arrival.  Needs the RocksDB state store.
    """
    found = phases(context.contextual(with_history_stream(messages)), configs, FIELDS)
    first = found.withColumn("punished", moderation.isolated("shown", "spelling"))
    out = T.StructType([*first.schema.fields, T.StructField("level_before", T.LongType())])
    leveled = first.groupBy("server_id", "author_id").transformWithStateInPandas(statefulProcessor=LevelProcessor(), outputStructType=out, outputMode="Append", timeMode="None")
    return moderation.violations(leveled)


def affection_stream(reactions: DataFrame) -> DataFrame:
    """Affection from reactions by directed pair, for output mode ``complete`` or ``update``."""
    liked = stats.admitted_reactions(reactions).withColumn("affection", reaction_affection(F.col("emoji")))
    return liked.groupBy("server_id", F.col("reactor_id").alias("src_id"), F.col("author_id").alias("dst_id")).agg(F.sum("affection").alias("affection"))


def start_actions(judged: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends actions and warnings below ``path`` as Parquet; both come from one pass."""

    def save(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own files
        for name, rows in (("actions", moderation.actions(batch)), ("warnings", moderation.warnings(batch))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return judged.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()


def start_monitor(figures: DataFrame, name: str, heat: str, show: Callable[[list], None], checkpoint: str, seconds: int = 2, rows: int = 50) -> StreamingQuery:
    """Starts a query that hands the hottest ``rows`` lines of the monitor's table to ``show``, again and again.

    ``figures`` are statistics of a stream by channel or member.
    """

    def report(batch: DataFrame, _: int) -> None:
        ranked = monitor.ranked(batch.where(F.col(heat).isNotNull()), name, heat)
        show([tuple(r) for r in ranked.orderBy(F.desc("rank")).limit(rows).collect()][::-1])

    return figures.writeStream.outputMode("complete").foreachBatch(report).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def stop(*queries: StreamingQuery) -> None:
    """Ends queries after a last flush: what has arrived is worked off and written first."""
    for q in queries:
        if q.isActive:
            q.processAllAvailable()
        q.stop()
