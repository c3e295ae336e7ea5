"""Windows over the preceding messages of a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura import constants as C
from murmura.functions.scores import context_depth, strip_markdown, u16_len
from murmura.operators.detect import server_spellings

ORDER = ["ts", "message_id"]


def channel_window(keys=("server_id", "channel_id"), order=tuple(ORDER)):
    return Window.partitionBy(*keys).orderBy(*order)


def with_history(messages: DataFrame, most: int = C.MAX_DEPTH, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``history``: structs of the channel's ``most`` messages before each one, oldest first.

    The window covers all rows of the channel, also those that are themselves
    never judged; filter afterwards.
    """
    entry = F.struct("message_id", "author_id", "content", *extra)
    return messages.withColumn("history", F.collect_list(entry).over(channel_window().rowsBetween(-most, -1)))


def last(history: Column, depth: Column) -> Column:
    """The newest ``depth`` entries."""
    n = F.least(depth, F.size(history))
    return F.when(n > 0, F.slice(history, F.size(history) - n + 1, n)).otherwise(F.slice(history, 1, 0))


def with_context(messages: DataFrame) -> DataFrame:
    """Adds ``plain`` (without markup), ``depth``, ``gated`` and ``context``.

    The context joins the author's own messages among the newest ``depth`` with
    the current one; only short messages are gated in.
    """
    return contextual(with_history(messages))


def contextual(rows: DataFrame) -> DataFrame:
    """``with_context`` for rows that carry their ``history``, from a table or a stream."""
    rows = rows.withColumn("plain", strip_markdown(F.col("content")))
    depth = context_depth(u16_len(F.col("plain")))
    own = F.filter(last(F.col("history"), depth), lambda h: h["author_id"] == F.col("author_id"))
    parts = F.filter(F.transform(own, lambda h: strip_markdown(h["content"])), lambda t: t != "")
    return (
        rows.withColumn("depth", depth)
        .withColumn("gated", u16_len(F.col("plain")) < C.CONTEXT_GATE)
        .withColumn("context", F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " "), F.lit(" "), F.col("plain"))).otherwise(F.col("plain")))
    )


def packed(text: Column) -> Column:
    """Text without white space."""
    return F.regexp_replace(text, r"\s+", "")


def collaborative(messages: DataFrame, patterns: DataFrame, norm: str = "packed_norm") -> DataFrame:
    """Messages that complete a word spelled by several authors.

    ``patterns`` is the table of ``detect.patterns_table``; ``norm`` is the
    normalised packed text of each message.  The newest messages
    are joined with spaces; the first pattern counts whose match first occurs across at
    least three messages of at least two authors.  Adds ``spelling``,
    ``involved_messages`` and ``involved_authors``.
    """
    gated = u16_len(F.col("plain")) < C.CONTEXT_GATE
    wide = with_history(messages.withColumn("plain", strip_markdown(F.col("content"))), extra=("plain", norm))
    depth = context_depth(u16_len(F.col("plain")))
    now = F.struct("message_id", "author_id", "content", "plain", norm)
    told = F.filter(last(F.col("history"), depth), lambda h: h["plain"] != "")
    out = wide.where(gated).join(F.broadcast(patterns), "server_id").withColumn("_all", F.concat(told, F.array(now)))
    # no separator stands before the first text that isn't empty
    skip = F.aggregate("_all", F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), lambda s, h: F.struct((s["n"] + F.when(s["done"] | (h[norm] != ""), 0).otherwise(1)).alias("n"), (s["done"] | (h[norm] != "")).alias("done")), lambda s: s["n"])
    out = out.withColumn("_all", F.slice("_all", skip + 1, F.size("_all")))
    out = out.withColumn("_joined", F.array_join(F.transform("_all", lambda h: h[norm]), " "))
    out = out.select("*", F.posexplode(server_spellings("_joined")).alias("_nth", "spelling")).drop("some", "patterns")
    start = F.expr("locate(spelling, _joined) - 1")
    out = out.withColumn("_from", start).withColumn("_to", F.col("_from") + F.length("spelling"))
    before = lambda i: F.when(i == 0, 0).otherwise(F.length(F.array_join(F.transform(F.slice("_all", 1, i), lambda h: h[norm]), " ")) + 1)
    within = F.filter("_all", lambda h, i: (before(i) < F.col("_to")) & (before(i) + F.length(h[norm]) > F.col("_from")))
    out = out.withColumn("_in", within)
    out = out.withColumn("involved_messages", F.transform("_in", lambda h: h["message_id"])).withColumn("involved_authors", F.array_sort(F.array_distinct(F.transform("_in", lambda h: h["author_id"]))))
    fits = (F.size("involved_messages") >= 3) & (F.size("involved_authors") >= 2)
    first = F.row_number().over(Window.partitionBy("server_id", "channel_id", "message_id").orderBy("_nth"))
    return out.where(fits).withColumn("_first", first).where("_first = 1").drop("_all", "_joined", "_from", "_to", "_in", "_nth", "_first", "history")


def reply_depth(messages: DataFrame) -> DataFrame:
    """``(message_id, depth)``: how many messages a chain of replies goes back.

    Pointers double each round, so a chain of n replies takes log2(n) joins; a
    chain that ends at an unknown message counts up to it.  Each round ends some
    chain unless only cycles are left, whose depth is the steps followed so far.
    """
    from murmura.scratch import materialize

    links = messages.select("message_id", F.col("reply_to_message_id").alias("up"), F.when(F.col("reply_to_message_id").isNull(), 0).otherwise(1).alias("depth"))
    links = materialize(links, "reply-links")
    left, before = links.where("up is not null").count(), None
    while left and (before is None or left < before):
        far = links.select(F.col("message_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        links = materialize(links.join(far, "up", "left").select("message_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "reply-links")
        left, before = links.where("up is not null").count(), left
    return links.select("message_id", "depth")
