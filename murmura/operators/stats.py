"""Statistics of members, channels and pairs of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura import constants as C
from murmura.functions.scores import timeout_seconds


def admitted_messages(m: DataFrame) -> DataFrame:
    return m.where(~F.col("is_bot") & ~F.col("is_webhook") & (F.col("channel_type") == "TEXT"))


def admitted_edits(m: DataFrame) -> DataFrame:
    return m.where(~F.col("is_bot") & (F.col("channel_type") == "TEXT"))


def admitted_reactions(r: DataFrame) -> DataFrame:
    return r.where(~F.col("is_bot") & (F.col("reactor_id") != F.col("author_id")))


def scored_events(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits count as further messages."""
    return admitted_messages(messages).unionByName(admitted_edits(edits))


def member_stats(scored: DataFrame, keys: list[str], heat: str = "heat") -> DataFrame:
    """Mean, count, record and bucket figures per member; partial sums before the shuffle."""
    h = F.col(heat)
    high, moderate = (h > C.HIGH) & (h <= C.EXTREME), (h > C.MODERATE) & (h <= C.HIGH)
    return scored.groupBy(*keys).agg(
        F.avg(h).alias("average_heat"),
        F.count(h).alias("message_count"),
        F.greatest(F.lit(0.0), F.max(h)).alias("record_high"),
        F.count_if(moderate).alias("moderate_messages"),
        F.coalesce(F.avg(F.when(moderate, h)), F.lit(0.0)).alias("moderate_average"),
        F.count_if(high).alias("high_messages"),
        F.coalesce(F.avg(F.when(high, h)), F.lit(0.0)).alias("high_average"),
        F.count_if(h > C.EXTREME).alias("extreme_messages"),
    )


def running_mean(df: DataFrame, keys: list[str], order: list[str], heat: str = "heat") -> DataFrame:
    """Each member's mean after every message."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.avg(heat).over(w)).withColumn("running_count", F.count(heat).over(w))


def backfilled_count(count: Column, extreme: Column, high: Column, moderate: Column, average: Column) -> Column:
    """Message counts of old statistics that lack them."""
    known = extreme + high + moderate
    return F.when(count != 0, count).when(known > 0, known).when(average > 0, 1).otherwise(0)


def infractions(events: DataFrame, keys: list[str], order: list[str], punished: Column) -> DataFrame:
    """Adds ``level_before``: how often the member was punished before each event."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("punished", punished).withColumn("level_before", F.coalesce(F.count_if("punished").over(w), F.lit(0)))


def infraction_totals(punishments: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Level, total, last date and the date of decay per member."""
    day = F.max(F.to_date(ts))
    return punishments.groupBy(*keys).agg(
        F.count("*").alias("infraction_level"),
        F.count("*").alias("total_infractions"),
        F.date_format(day, "yyyy-MM-dd").alias("last_date"),
        F.date_format(F.date_add(day, C.DECAY_DAYS), "yyyy-MM-dd").alias("reduction_date"),
    )


def timeouts(events: DataFrame, mode: str, base: int) -> DataFrame:
    """Adds ``seconds`` by the level before the event: a first offence has none."""
    return events.withColumn("seconds", timeout_seconds(F.col("level_before"), F.lit(mode), F.lit(base)))


def pair_affection(changes: DataFrame, first_seen: DataFrame | None = None) -> DataFrame:
    """Affection by directed pair.

    ``changes``: server_id, src_id, dst_id, ts, affection.  With ``first_seen``
    (server_id, member_id, first_ts) only changes count whose both members were
    seen strictly earlier.
    """
    if first_seen is not None:
        for end in ("src_id", "dst_id"):
            seen = first_seen.select("server_id", F.col("member_id").alias(end), F.col("first_ts").alias("_first"))
            changes = changes.join(seen, ["server_id", end]).where("_first < ts").drop("_first")
    return changes.groupBy("server_id", "src_id", "dst_id").agg(F.sum("affection").alias("affection"))


def relation_class(affection: Column, mutual: Column) -> Column:
    return (
        F.when((affection > 5) & (mutual > 5), "mutual")
        .when((affection > 5) & (mutual <= 1), "one-sided")
        .when((affection < -5) | (mutual < -5), "negative")
    )


def classified_relations(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations whose target is known, with the reverse affection (0 if none) and their class, if any."""
    known = relations.join(members.select("server_id", F.col("member_id").alias("dst_id")), ["server_id", "dst_id"], "left_semi")
    back = relations.select("server_id", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.col("affection").alias("mutual"))
    out = known.join(back, ["server_id", "src_id", "dst_id"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(0.0)))
    return out.withColumn("class", relation_class(F.col("affection"), F.col("mutual"))).where("class is not null")


def named_targets(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Target names for target ids; unknown ids get a placeholder name."""
    names = members.select(F.col("member_id").alias("dst_id"), "member_name")
    name = F.coalesce("member_name", F.concat(F.lit(C.UNKNOWN_MEMBER), F.col("dst_id")))
    return relations.join(names, "dst_id", "left").withColumn("target_name", name).drop("member_name", "dst_id")


def live_only(stats: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Statistics of channels that still exist."""
    return stats.join(live.select(key).distinct(), key, "left_semi")


def missing(servers: DataFrame, configs: DataFrame, key: str) -> DataFrame:
    """Servers without a configuration."""
    return servers.join(configs.select(key).distinct(), key, "left_anti")


def channel_activity(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Messages per minute, busiest hour of the day and share of distinct authors per channel.

    An extension: such fields exist in the statistics and nothing fills them.
    The rate runs from the first to the last message, a minute at least; of
    equally busy hours the earliest counts.
    """
    hours = messages.groupBy(*keys, F.hour("ts").alias("_hour")).agg(F.count("*").alias("_n"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    minutes = F.greatest(F.lit(1.0), (F.unix_micros(F.max("_last").cast("timestamp")) - F.unix_micros(F.min("_first").cast("timestamp"))) / 60e6)
    rates = hours.groupBy(*keys).agg((F.sum("_n") / minutes).alias("messages_per_minute"), F.max(F.struct("_n", -F.col("_hour")))["_n"].alias("peak_messages"), (-F.max(F.struct("_n", (-F.col("_hour")).alias("h")))["h"]).alias("peak_hour"))
    authors = messages.groupBy(*keys).agg((F.count_distinct("author_id") / F.count("*")).alias("diversity"))
    return rates.join(authors, keys)
