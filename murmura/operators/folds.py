"""Ordered folds: channel heat, its last values, alerts and cooldowns.

Rows are dealt by key, sorted within partitions and folded batch by batch, so a
task keeps one row of state however long a channel is.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura import constants as C


def next_average(average: float, heat: float) -> float:
    """The channel's moving average: quick to rise, slower to fall, seeded again at zero."""
    if average == 0:
        return heat
    return C.RISE * heat + (1 - C.RISE) * average if heat > average else C.FALL * average + C.FALL * heat


class ChannelState:
    """What a channel remembers: its average, its last averages and its last alert."""

    def __init__(self, average: float = 0.0, ring=(), alerted: int | None = None):
        self.average, self.ring, self.alerted = average, deque(ring, C.RING), alerted

    def push(self, heat: float, micros: int, cooldown: int) -> tuple[float, int, float, bool, bool]:
        """``(average, samples, mean of the ring, hot, alert)`` after one message."""
        self.average = next_average(self.average, heat)
        self.ring.append(self.average)
        mean = sum(self.ring) / len(self.ring)
        hot = self.average > C.ALERT_AVERAGE and len(self.ring) >= C.SUSTAINED_SAMPLES and mean >= C.SUSTAINED_MEAN
        alert = hot and (self.alerted is None or micros - self.alerted >= cooldown * 1_000_000)
        if alert:
            self.alerted = micros
        return self.average, len(self.ring), mean, hot, alert


def channel_heat(df: DataFrame, keys: list[str], order: list[str], heat: str = "heat", ts: str = "ts", cooldown: int = 60) -> DataFrame:
    """Adds average, samples, ring_mean, hot and alert after every message, in order.

    A null heat leaves the state as it is and repeats the average.
    """
    added = ["average", "samples", "ring_mean", "hot", "alert"]

    def run(batches):
        key, state = None, ChannelState()
        for pdf in batches:
            out = []
            times = pdf["_us"].tolist()
            for here, h, us in zip(pdf[keys].itertuples(index=False, name=None), pdf[heat].tolist(), times, strict=True):
                here = tuple(None if pd.isna(x) else x for x in here)
                if here != key:
                    key, state = here, ChannelState()
                if h is None or h != h:
                    mean = sum(state.ring) / len(state.ring) if state.ring else 0.0
                    out.append((state.average, len(state.ring), mean, False, False))
                else:
                    out.append(state.push(float(h), us, cooldown))
            yield pdf.drop(columns="_us").assign(**dict(zip(added, zip(*out, strict=True), strict=True))) if out else pdf.drop(columns="_us").reindex(columns=[*pdf.columns.drop("_us"), *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    dealt = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, f"{fields}, average double, samples int, ring_mean double, hot boolean, alert boolean")


def sustained(average: Column, window) -> Column:
    """The ring's rule as window functions over averages that are already known."""
    ring = window.rowsBetween(1 - C.RING, 0)
    return (average > C.ALERT_AVERAGE) & (F.count(average).over(ring) >= C.SUSTAINED_SAMPLES) & (F.avg(average).over(ring) >= C.SUSTAINED_MEAN)


def final_average(df: DataFrame, keys: list[str], order: list[str], heat: str = "heat") -> DataFrame:
    """Only the last average of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    folded = channel_heat(df, keys, order, heat)
    return folded.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def thinned(df: DataFrame, keys: list[str], order: list[str], cooldown: int, ts: str = "ts") -> DataFrame:
    """The rows that are ``cooldown`` seconds or more after the last one kept of their key; the first stays.

    One number of state for each key, however many rows it has.  Rows without a
    time go.
    """

    def run(batches):
        key, last = None, None
        for pdf in batches:
            kept = []
            for here, second in zip(pdf[keys].itertuples(index=False, name=None), pdf["_s"].tolist(), strict=True):
                here = tuple(None if pd.isna(x) else x for x in here)
                if here != key:
                    key, last = here, None
                kept.append(last is None or second - last >= cooldown)
                if kept[-1]:
                    last = second
            yield pdf[np.array(kept, bool)].drop(columns="_s")

    timed = df.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp"))).where("_s is not null")
    return timed.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, df.schema)
