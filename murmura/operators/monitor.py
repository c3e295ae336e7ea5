"""The monitor's tables: channels and users by rising heat, and both side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.scores import heat_bar
from murmura.operators.ranks import numbered


def ranked(stats: DataFrame, name: str, heat: str) -> DataFrame:
    """``rank``, name, heat and bar by rising heat, ties by name; one row for each channel or member."""
    rows = numbered(stats.select(F.col(name).alias("name"), F.col(heat).alias("heat")), [F.col("heat"), F.col("name")], "rank")
    return rows.select((F.col("rank") + 1).cast("int").alias("rank"), "name", "heat", heat_bar(F.col("heat")).alias("bar"))


def side_by_side(channels: DataFrame, users: DataFrame) -> DataFrame:
    left = channels.select("rank", F.col("name").alias("channel"), F.col("heat").alias("channel_heat"), F.col("bar").alias("channel_bar"))
    right = users.select("rank", F.col("name").alias("user"), F.col("heat").alias("user_heat"), F.col("bar").alias("user_bar"))
    return left.join(right, "rank", "full_outer")
