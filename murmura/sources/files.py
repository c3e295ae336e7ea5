"""Files of the moderation application: dictionaries, configurations, statistics and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura import constants as C
from murmura import schemas as S
from murmura.functions.scores import archive_line, is_image_url
from murmura.operators.stats import backfilled_count


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per file; a broken file gives a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """``(word, heat, kind)`` of a keyword file, kind ``hot`` or ``safe``."""
    raw = _json(spark, path, S.KEYWORDS_FILE)
    return raw.select(F.inline("keywords")).withColumn("kind", F.lit("hot")).unionByName(raw.select(F.inline("safeWords")).withColumn("kind", F.lit("safe")))


def keyword_maps(table: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """The dictionary as ``(hot, safe)`` for column expressions; a configuration bounds it."""
    rows = table.collect()
    return {r["word"]: r["heat"] for r in rows if r["kind"] == "hot"}, {r["word"]: r["heat"] for r in rows if r["kind"] == "safe"}


def setting(name: str) -> Column:
    """A server's setting or its default."""
    default = {
        "alert_cooldown_seconds": F.lit(60).cast("bigint"), "save_interval": F.lit(5), "timeout_mode": F.lit("flat"), "timeout_base_seconds": F.lit(60).cast("bigint"),
        "delete_filtered_messages": F.lit(False), "timeout_for_filtered_messages": F.lit(False), "banned_words": F.array().cast("array<string>"),
    }[name]
    return F.coalesce(F.col(f"config.{name}"), default)


def server_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configurations with an id; files that don't parse are skipped."""
    return _json(spark, path, S.SERVER_CONFIG).where("id is not null")


def stats_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The nested statistics as flat tables: servers, channels, members and relations."""
    raw = _json(spark, path, S.SERVER_STATS).where("serverId is not null")
    channels = raw.select("serverId", F.explode("channels").alias("id", "c")).select("serverId", "c.*")
    members = raw.select("serverId", F.explode("members").alias("id", "m")).select("serverId", "m.*")
    count = backfilled_count(F.coalesce("messageCount", F.lit(0)), F.coalesce("extremeHeatMessages", F.lit(0)), F.coalesce("highHeatMessages", F.lit(0)), F.coalesce("moderateHeatMessages", F.lit(0)), F.coalesce("averageHeatLevel", F.lit(0.0)))
    return {
        "servers": raw.select("serverName", "serverId", "totalMessagesAnalyzed", "totalInfractions"),
        "channels": channels,
        "members": members.drop("relations").withColumn("messageCount", count.cast("int")),
        "relations": members.select("serverId", F.col("memberId").alias("src_id"), F.explode("relations").alias("r")).select("serverId", "src_id", F.col("r.targetMemberId").alias("dst_id"), "r.affection"),
    }


def with_fresh(configs: DataFrame, servers: DataFrame) -> DataFrame:
    """Statistics of every configured server; servers without any start at zero."""
    joined = configs.select(F.col("id").alias("serverId"), F.col("name").alias("_name")).join(servers, "serverId", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("totalMessagesAnalyzed", "totalInfractions")}
    return joined.withColumn("serverName", F.coalesce("serverName", "_name")).withColumns(zero).drop("_name")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """The flat tables as one nested object per server, in a folder per server."""
    r = tables["relations"].groupBy("serverId", F.col("src_id").alias("memberId")).agg(F.collect_list(F.struct(F.col("dst_id").alias("targetMemberId"), "affection")).alias("relations"))
    m = tables["members"].join(r, ["serverId", "memberId"], "left")
    body = F.struct(*[c for c in m.columns if c != "serverId"])
    m = m.groupBy("serverId").agg(F.map_from_entries(F.collect_list(F.struct(F.col("memberId").alias("k"), body.alias("v")))).alias("members"))
    c = tables["channels"]
    c = c.groupBy("serverId").agg(F.map_from_entries(F.collect_list(F.struct(F.col("channelId").alias("k"), F.struct(*[x for x in c.columns if x != "serverId"]).alias("v")))).alias("channels"))
    out = tables["servers"].join(c, "serverId", "left").join(m, "serverId", "left").withColumn("server_id", F.col("serverId"))
    out.write.mode("overwrite").partitionBy("server_id").json(path)


def readable_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics whose relations name their targets; members may be a list or a map."""
    nested = _json(spark, path, S.SERVER_STATS).select("serverId", F.map_values("members").alias("members"))
    listed = _json(spark, path, S.SERVER_STATS_LIST).select(F.col("serverId").alias("_server"), F.col("members").alias("_listed"))
    both = nested.join(listed, F.col("serverId").eqNullSafe(F.col("_server")), "left").drop("_server")
    rows = both.select("serverId", F.explode(F.coalesce("members", "_listed")).alias("m")).select("serverId", "m.*")
    names = rows.select(F.col("memberId").alias("targetMemberId"), F.col("memberName").alias("_name")).dropDuplicates(["targetMemberId"])
    rel = rows.select("serverId", "memberId", F.explode("relations").alias("r")).select("serverId", "memberId", "r.*").join(names, "targetMemberId", "left")
    told = rel.groupBy("serverId", "memberId").agg(F.collect_list(F.struct("affection", F.coalesce("_name", F.concat(F.lit(C.UNKNOWN_MEMBER), F.col("targetMemberId"))).alias("targetMemberName"))).alias("relations"))
    return rows.drop("relations").join(told, ["serverId", "memberId"], "left")


def write_readable(stats: DataFrame, path: str) -> None:
    """Enriched statistics as JSON, one member per line."""
    stats.write.mode("overwrite").json(path)


def default_configs(servers: DataFrame, configs: DataFrame, banned_words: list[str]) -> DataFrame:
    """Configurations for ``servers(id, name)`` that have none."""
    words = F.array(*[F.lit(w) for w in banned_words]).cast("array<string>")
    off, none = F.lit(False), F.lit(None).cast("string")
    body = F.struct(
        off.alias("word_filter"), off.alias("delete_filtered_messages"), off.alias("timeout_for_filtered_messages"), off.alias("slowmode_alerts"),
        none.alias("log_channel_id"), none.alias("alert_channel_id"), none.alias("warning_channel_id"), F.lit(60).cast("bigint").alias("alert_cooldown_seconds"),
        F.lit(5).alias("save_interval"), F.lit("flat").alias("timeout_mode"), F.lit(60).cast("bigint").alias("timeout_base_seconds"), words.alias("banned_words"),
    )
    return servers.join(configs.select("id"), "id", "left_anti").select("name", "id", body.alias("config"))


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of archive files; numbers rise within a file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def write_archive(messages: DataFrame, path: str) -> None:
    """Messages as archive lines, oldest first."""
    lines = messages.orderBy("ts", "message_id").select(archive_line(F.col("ts"), F.col("author_name"), F.col("content")).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_cleaned(scored: DataFrame, path: str) -> None:
    """The kept lines of a scored archive in their order."""
    scored.where("kept").orderBy("line_no").select("line").write.mode("overwrite").text(path)


def image_urls(messages: DataFrame) -> DataFrame:
    """Adds ``image_urls``: the distinct addresses of image attachments."""
    url = F.transform(F.filter("attachments", lambda a: a["is_image"]), lambda a: a["url"])
    fits = F.filter(url, is_image_url)
    return messages.withColumn("image_urls", F.coalesce(F.array_distinct(fits), F.array().cast("array<string>")))


def ocr_results(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Adds the better reading of a message's image; without any it is empty."""
    from murmura.functions.scores import best_ocr

    read = results.select("message_id", best_ocr(F.col("ocr_color"), F.col("ocr_gray")).alias("ocr_text"))
    return messages.join(read, "message_id", "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))
