"""``python -m murmura``: one-off reports on texts, archives and statistics."""

from __future__ import annotations

import argparse
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura import schemas
from murmura.functions import patterns, scores
from murmura.functions.normalize import normalize, normalizer
from murmura.operators import archive, detect, folds, monitor, stats
from murmura.plans.moderate import heat_breakdown, moderate
from murmura.sources import files


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="murmura", description=__doc__)
    parser.add_argument("--keywords", help="keyword file (JSON)")
    sub = parser.add_subparsers(dest="mode", required=True)
    for name, what in (("check", "text"), ("ocr", "text"), ("analyze-archive", "path"), ("clean-archive", "path"), ("relations", "path")):
        sub.add_parser(name).add_argument(what)
    sub.choices["clean-archive"].add_argument("out")
    sub.choices["relations"].add_argument("--server")
    m = sub.add_parser("monitor")
    m.add_argument("path")
    m.add_argument("server")
    m.add_argument("kind", choices=["channels", "users", "unified"], nargs="?", default="unified")
    sub.add_parser("keyspace").add_argument("words", nargs="+")
    for name, more in (("archive", ["out"]), ("benchmark", ["word"]), ("moderate", ["configs", "out"]), ("live", ["configs", "out", "checkpoint"])):
        p = sub.add_parser(name)
        p.add_argument("messages", help="folder of Parquet files")
        for x in more:
            p.add_argument(x)
    sub.choices["moderate"].add_argument("--reactions")
    sub.choices["moderate"].add_argument("--diet", action="store_true", help="each message by itself")
    sub.choices["moderate"].add_argument("--debug", action="store_true", help="every part of each message's heat as well")
    sub.choices["benchmark"].add_argument("--token", help="only people's messages that hold this text")
    sub.choices["live"].add_argument("--once", action="store_true", help="end when all that has arrived is done")
    return parser


def benchmark(messages: DataFrame, word: str) -> None:
    """What both detectors find of a word, how they differ, and the seconds that each takes."""
    rows = messages.select(F.col("content"), normalize(F.col("content")).alias("norm"))
    detect.compare(rows, "content", "norm", word).show()
    patterns_of = patterns.pattern_rows([word], normalizer())
    timed = {"live": rows.withColumn("found", detect.first_match(F.col("norm"), patterns_of)), "multipass": detect.multipass(rows, "content", word)}
    n = rows.count()
    for name, plan in timed.items():
        took = []
        for _ in range(4):  # the first also compiles
            began = time.perf_counter()
            plan.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        middle = statistics.median(took[1:])
        print(f"{name}: {n} messages in {middle:.3f} s, {1e3 * middle / max(1, n):.4f} ms each")


def live(spark: SparkSession, args: argparse.Namespace) -> None:
    """Actions, warnings and statistics of the messages that arrive in a folder."""
    from murmura.streaming import heat, live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    messages = heat.live_messages(spark, args.messages, schemas.MESSAGES)
    judged = live.judged_stream(messages, files.server_configs(spark, args.configs))
    scored = heat.admitted(messages).withColumn("heat", scores.heat_index(F.col("content"), 0.0))
    members = heat.member_stats_stream(scored)
    queries = [
        live.start_actions(judged, args.out, f"{args.checkpoint}/actions"),
        heat.save_snapshots(members, f"{args.out}/members", f"{args.checkpoint}/members"),
        live.start_monitor(members, "author_id", "average_heat", lambda rows: print(*rows, sep="\n"), f"{args.checkpoint}/monitor"),
    ]
    try:
        if not args.once:
            spark.streams.awaitAnyTermination()
    finally:
        live.stop(*queries)


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    if args.mode == "keyspace":
        for row in patterns.keyspace(args.words, normalizer()):
            print(row)
        return
    spark = SparkSession.builder.appName("murmura").getOrCreate()
    hot, safe = files.keyword_maps(files.keywords(spark, args.keywords)) if args.keywords else ({}, {})
    if args.mode == "check":
        heat_breakdown(spark.createDataFrame([(args.text,)], "text string"), "text", hot, safe).show(truncate=False)
    elif args.mode == "ocr":
        df = spark.createDataFrame([(args.text,)], "text string")
        df.select(scores.ocr_clean(F.col("text")).alias("clean"), scores.trigram_count(F.col("text")).alias("trigrams")).show(truncate=False)
    elif args.mode == "archive":
        files.write_archive(spark.read.schema(schemas.MESSAGES).parquet(args.messages), args.out)
    elif args.mode == "benchmark":
        messages = spark.read.schema(schemas.MESSAGES).parquet(args.messages)
        benchmark(messages.where(~F.col("is_bot") & F.col("content").contains(args.token)) if args.token else messages, args.word)
    elif args.mode == "live":
        live(spark, args)
    elif args.mode == "moderate":
        messages = spark.read.schema(schemas.MESSAGES).parquet(args.messages)
        reactions = spark.read.schema(schemas.REACTIONS).parquet(args.reactions) if args.reactions else spark.createDataFrame([], schemas.REACTIONS)
        out = moderate(messages, reactions, files.server_configs(spark, args.configs), hot, safe, args.diet)
        if args.debug:
            out["breakdown"] = heat_breakdown(messages.drop("attachments"), "content", hot, safe)
        for name, rows in out.items():
            rows.write.mode("overwrite").parquet(f"{args.out}/{name}")
    elif args.mode == "analyze-archive":
        lines = archive.replayed(files.archive_lines(spark, args.path))
        heat = heat_breakdown(lines, "message", hot, safe).select(F.lit("archive").alias("channel_id"), "line_no", F.current_timestamp().alias("ts"), "heat")
        folded = folds.channel_heat(heat, ["channel_id"], ["line_no"])
        archive.order_statistics(folded, "average", ["channel_id"]).show(truncate=False)
        print(archive.line_graph([r["average"] for r in archive.sampled(folded, ["channel_id"], ["line_no"]).orderBy("position").collect()]))
    elif args.mode == "clean-archive":
        scored = archive.scored_lines(files.archive_lines(spark, args.path))
        files.write_cleaned(scored, args.out)
        archive.cleaning_report(scored).show()
        archive.removed_samples(scored, "line_no").show(truncate=False)
    else:
        tables = files.stats_snapshot(spark, args.path)
        if args.mode == "relations":
            r = tables["relations"].withColumnRenamed("serverId", "server_id")
            r = r.where(F.col("server_id") == args.server) if args.server else r
            m = tables["members"].select(F.col("serverId").alias("server_id"), F.col("memberId").alias("member_id"))
            stats.classified_relations(r, m).show(truncate=False)
        else:
            c = monitor.ranked(tables["channels"].where(F.col("serverId") == args.server), "channelName", "averageHeatIndex")
            u = monitor.ranked(tables["members"].where(F.col("serverId") == args.server), "memberName", "averageHeatLevel")
            {"channels": c, "users": u, "unified": monitor.side_by_side(c, u)}[args.kind].orderBy("rank").show(1000, truncate=False)


if __name__ == "__main__":
    main()
