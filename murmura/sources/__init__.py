"""Readers and writers of configurations, dictionaries, statistics and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer splits than there are cores.

    A single small file is one split; work on texts would then run in one task.
    Larger inputs, with splits enough, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
