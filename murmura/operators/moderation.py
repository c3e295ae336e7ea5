"""What follows from a violation: timeouts, warnings, deletions and punishments, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.scores import alert_color, format_duration, shorten, timeout_seconds


def scored_messages(messages: DataFrame, text: str = "content") -> DataFrame:
    """Messages with ``analysed`` text; those that are empty, or only links without an image, go.

    An empty text always goes; links with an image are analysed as an empty text.
    """
    from murmura.functions.scores import strip_urls

    out = messages.withColumn("analysed", strip_urls(F.col(text)))
    return out.where((F.col(text) != "") & ((F.col("analysed") != "") | (F.size("image_urls") > 0)))


def isolated(text: str, word: str) -> Column:
    """Whether the raw text holds the row's spelling between word boundaries, in any ASCII case."""
    return F.expr(rf"{text} rlike concat('(?i)\\b\\Q', {word}, '\\E\\b')")


# Fixed value: how a reason begins.
REASON = "Used or attempted to use banned word: "


def violations(hits: DataFrame) -> DataFrame:
    """Adds seconds, timed_out, reason, deleted and punished to detections.

    ``hits``: word, spelling (as found in the normalised text), shown (the text
    that is reported), level_before and the server's settings.  The level before the offence sets the length, so a first
    offence is never timed out; only spellings that stand alone in the
    reported text are punished.
    """
    seconds = timeout_seconds(F.col("level_before"), F.col("timeout_mode"), F.col("timeout_base_seconds"))
    return (
        hits.withColumn("seconds", seconds)
        .withColumn("timed_out", F.col("timeout_for_filtered_messages") & (F.col("seconds") > 0))
        .withColumn("reason", F.concat(F.lit(REASON), F.col("word")))
        .withColumn("deleted", F.col("delete_filtered_messages"))
        .withColumn("punished", isolated("shown", "spelling"))
    )


def warnings(judged: DataFrame) -> DataFrame:
    """Warning rows of servers with a warning channel."""
    kept = judged.where("warning_channel_id is not null and warning_channel_id != ''")
    return kept.select("server_id", "author_id", "reason", shorten(F.col("shown")).alias("shown"), "timed_out", F.when(F.col("timed_out"), format_duration(F.col("seconds"))).alias("timeout"))


def actions(judged: DataFrame) -> DataFrame:
    """One row for each deletion, timeout and punishment."""
    each = F.array_compact(
        F.array(
            F.when(F.col("timed_out"), F.struct(F.lit("timeout").alias("action"), F.col("seconds").cast("bigint").alias("seconds"))),
            F.when(F.col("deleted"), F.struct(F.lit("delete").alias("action"), F.lit(0).cast("bigint").alias("seconds"))),
            F.when(F.col("punished"), F.struct(F.lit("punish").alias("action"), F.lit(0).cast("bigint").alias("seconds"))),
        )
    )
    return judged.select("server_id", "author_id", "message_id", F.explode(each).alias("_a")).select("server_id", "author_id", "message_id", "_a.*")


def alerts(folded: DataFrame) -> DataFrame:
    """Alert rows of folded channel heat, with the colour of their average.

    With a column ``alert_channel_id``, servers without one get none.
    """
    if "alert_channel_id" in folded.columns:
        folded = folded.where("alert_channel_id is not null")
    return folded.where("alert").withColumn("color", alert_color(F.col("average")))


def collaborative_actions(found: DataFrame, level: DataFrame) -> DataFrame:
    """Deletions of all involved messages and timeouts of involved authors with a level.

    ``found`` carries the server's settings; ``level``: server_id, author_id,
    level_before.  Authors at level 0 get nothing, deletions don't ask for levels.
    """
    deleted = found.where("delete_filtered_messages").select("server_id", F.explode("involved_messages").alias("message_id"), F.lit(None).cast("string").alias("author_id"), F.lit("delete").alias("action"), F.lit(0).cast("bigint").alias("seconds"))
    who = found.where("timeout_for_filtered_messages").select("server_id", "message_id", "timeout_mode", "timeout_base_seconds", F.explode("involved_authors").alias("author_id"))
    timed = who.join(level, ["server_id", "author_id"], "left").withColumn("seconds", timeout_seconds(F.coalesce("level_before", F.lit(0)), F.col("timeout_mode"), F.col("timeout_base_seconds")))
    return deleted.unionByName(timed.where("seconds > 0").select("server_id", "message_id", "author_id", F.lit("timeout").alias("action"), "seconds"))
