"""The whole moderation plan over a batch of messages, edits and reactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import scores
from murmura.functions.normalize import normalize
from murmura.operators import context, detect, folds, moderation, stats
from murmura.scratch import bounded_broadcast, materialize
from murmura.sources.files import image_urls, setting

MEMBER = ["server_id", "author_id"]
SETTINGS = ["timeout_mode", "timeout_base_seconds", "timeout_for_filtered_messages", "delete_filtered_messages", "alert_cooldown_seconds"]


def admitted(rows: DataFrame) -> DataFrame:
    """New messages of people in text channels, and edits, which have no webhook rule."""
    new = (F.col("event_kind") == "message") & ~F.col("is_webhook")
    return rows.where(~F.col("is_bot") & (F.col("channel_type") == "TEXT") & (new | (F.col("event_kind") == "edit")))


def with_settings(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Rows of configured servers with their settings."""
    flat = configs.select(F.col("id").alias("server_id"), "config.warning_channel_id", "config.alert_channel_id", *[setting(s).alias(s) for s in SETTINGS])
    few, _ = bounded_broadcast(flat, detect.MOST_SERVERS)
    return rows.join(few, "server_id")


def detections(messages: DataFrame, configs: DataFrame, diet: bool = False) -> DataFrame:
    """Admitted messages with a banned word: phase, word, spelling and the text that is reported.

    Windows cover all rows of a channel, bots and webhooks too, before anything
    is filtered.  ``diet`` looks at the message itself only.
    """
    plain = messages.withColumn("plain", scores.strip_markdown(F.col("content")))
    rows = plain.withColumns({"gated": F.lit(False), "context": F.col("plain")}) if diet else context.with_context(messages).drop("history", "depth")
    return phases(rows, configs, [x for x in messages.columns if x != "attachments"])


def phases(rows: DataFrame, configs: DataFrame, keep: list[str]) -> DataFrame:
    """``detections`` of rows that carry ``plain``, ``gated`` and ``context``, from a table or a stream; with the columns of ``keep``."""
    rows = with_settings(admitted(rows), configs).join(F.broadcast(detect.patterns_table(rows.sparkSession, configs)), "server_id")
    rows = rows.withColumns({"_a": normalize(F.col("plain")), "_b": normalize(F.col("context")), "_c": normalize(context.packed(F.col("context")))})
    longer = F.col("gated") & (scores.u16_len(F.col("context")) > scores.u16_len(F.col("plain")))
    a, b, c = detect.server_match("_a"), F.when(longer & F.col("delete_filtered_messages"), detect.server_match("_b")), F.when(longer, detect.server_match("_c"))
    found = rows.withColumns({"_fa": a, "_fb": b, "_fc": c}).where("coalesce(_fa, _fb, _fc) is not null")
    hit = F.coalesce("_fa", "_fb", "_fc")
    phase = F.when(F.col("_fa").isNotNull(), "message").when(F.col("_fb").isNotNull(), "context").otherwise("packed")
    # the context phase reports the whole context, the others the message
    shown = F.when(phase == "context", F.col("context")).otherwise(F.col("plain"))
    return found.select(*keep, phase.alias("phase"), hit["word"].alias("word"), hit["spelling"].alias("spelling"), shown.alias("shown"), "warning_channel_id", *SETTINGS)


def judged(found: DataFrame) -> DataFrame:
    """Detections with their consequences by the author's level before each."""
    first = found.withColumn("punished", moderation.isolated("shown", "spelling"))
    leveled = stats.infractions(first, MEMBER, ["ts", "message_id"], F.col("punished"))
    return moderation.violations(leveled)


def collaborations(messages: DataFrame, configs: DataFrame) -> DataFrame:
    """Messages that complete a word several authors spell, by each server's patterns."""
    rows = materialize(messages.withColumn("packed_norm", normalize(context.packed(scores.strip_markdown(F.col("content"))))).drop("attachments"), "packed")
    return context.collaborative(rows, detect.patterns_table(messages.sparkSession, configs))


def scored(messages: DataFrame, hot: dict[str, float], safe: dict[str, float]) -> DataFrame:
    """Admitted messages with a text to analyse, their keyword heat and event heat."""
    rows = image_urls(messages)
    depth = context.reply_depth(messages.where("event_kind = 'message'").dropDuplicates(["message_id"]))
    # an edit has no image to fall back on
    rows = moderation.scored_messages(admitted(rows)).where((F.col("event_kind") == "message") | (F.col("analysed") != ""))
    rows = rows.withColumn("norm", normalize(F.col("analysed"))).join(depth, "message_id", "left")
    keywords = detect.keyword_heat(F.col("norm"), hot, safe)
    heat = scores.event_heat(scores.heat_index(F.col("analysed"), keywords), F.coalesce("depth", F.lit(0)))
    return rows.withColumn("keyword_heat", keywords).withColumn("heat", heat).drop("norm", "image_urls", "attachments", "depth")


def heat_breakdown(rows: DataFrame, text: str, hot: dict[str, float], safe: dict[str, float]) -> DataFrame:
    """Every part of the heat index of a text, and their floored sum."""
    t = F.col(text)
    keywords = detect.keyword_heat(normalize(t), hot, safe)
    parts = {"keywords": keywords, "caps": scores.caps_score(t), "length": scores.length_score(t), "punctuation": scores.punctuation_score(t), "debate": scores.debate_score(t)}
    return rows.withColumns(parts).withColumn("heat", scores.heat_index(t, F.col("keywords")))


def affection(messages: DataFrame, reactions: DataFrame) -> DataFrame:
    """Affection by pair, from reactions and enthusiastic replies, of members seen before."""
    m = messages.where("event_kind = 'message'")
    target = m.select("server_id", F.col("message_id").alias("reply_to_message_id"), F.col("author_id").alias("dst_id"))
    replies = stats.admitted_messages(m).withColumn("affection", scores.reply_affection(F.col("content"))).where("affection is not null").join(target, ["server_id", "reply_to_message_id"])
    liked = stats.admitted_reactions(reactions).select("server_id", F.col("reactor_id").alias("src_id"), F.col("author_id").alias("dst_id"), "ts", scores.reaction_affection(F.col("emoji")).alias("affection"))
    changes = replies.select("server_id", F.col("author_id").alias("src_id"), "dst_id", "ts", "affection").unionByName(liked)
    seen = admitted(messages).groupBy("server_id", F.col("author_id").alias("member_id")).agg(F.min("ts").alias("first_ts"))
    return stats.pair_affection(changes, seen)


def moderate(messages: DataFrame, reactions: DataFrame, configs: DataFrame, hot: dict[str, float], safe: dict[str, float], diet: bool = False) -> dict[str, DataFrame]:
    """All results of a batch by name.

    messages, reactions and configs have the schemas of ``murmura.schemas``.
    Gives detections, actions, warnings, scored, members, channels, alerts and
    relations, and collaborations unless ``diet``.
    """
    found = materialize(judged(detections(messages, configs, diet)), "detections")
    heat = materialize(scored(messages, hot, safe), "scored")
    kept = with_settings(heat.where("event_kind = 'message'").select("server_id", "channel_id", "channel_name", "message_id", "ts", "heat", "event_kind"), configs)
    folded = materialize(folds.channel_heat(heat.select("server_id", "channel_id", "event_kind", "message_id", "ts", "heat"), ["server_id", "channel_id"], ["ts", "message_id"]), "folded")
    out = {
        "detections": found,
        "actions": moderation.actions(found),
        "warnings": moderation.warnings(found),
        "scored": heat,
        "members": stats.member_stats(heat, MEMBER),
        "channels": last_average(folded),
        # edits move averages and don't alert
        "alerts": moderation.alerts(folded.join(kept.select("server_id", "message_id", "channel_name", "alert_channel_id"), ["server_id", "message_id"]).where("event_kind = 'message'")),
        "relations": affection(messages, reactions),
    }
    if not diet:
        out["collaborations"] = collaborations(messages, configs)
    return out


def last_average(folded: DataFrame) -> DataFrame:
    w = Window.partitionBy("server_id", "channel_id").orderBy(F.desc("ts"), F.desc("message_id"))
    last = folded.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return last.select("server_id", "channel_id", F.col("average").alias("average_heat"))
