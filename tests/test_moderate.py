"""The whole plan on a small, hand-made chat."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmura import schemas as S
from murmura.plans.moderate import heat_breakdown, moderate

T0 = dt.datetime(2024, 1, 1)
OFF = dict.fromkeys(["word_filter", "slowmode_alerts"], False)


def message(n, author, content, kind="message", channel="c", bot=False, hook=False, reply=None, files=()):
    return (kind, "s", channel, channel, n, T0 + dt.timedelta(seconds=n), author, author.upper(), bot, hook, "TEXT", content, reply, [(f, True) for f in files])


def config(words, **more):
    base = {**OFF, "delete_filtered_messages": True, "timeout_for_filtered_messages": True, "log_channel_id": None, "alert_channel_id": "al", "warning_channel_id": "wa", "alert_cooldown_seconds": 60, "save_interval": 5, "timeout_mode": "flat", "timeout_base_seconds": 30, "banned_words": words}
    return ("one", "s", {**base, **more})


IMAGE = "https://cdn.discordapp.com/attachments/1/2/x.png?size=1"
CHAT = [
    message(1, "ann", "hello all"),
    message(2, "bob", "what a grabbit"),
    message(3, "bob", "gr4bbit again"),
    message(4, "ann", "grab", channel="d"),
    message(5, "bot", "grabbit", bot=True),
    message(6, "ann", "bit", channel="d"),
    message(7, "bob", "grabbits!", reply=1),
    message(8, "bob", "YESSS", reply=1),
    message(9, "cat", "https://x.y/z"),
    message(10, "cat", "https://x.y/z", files=[IMAGE]),
    message(11, "cat", ""),
    message(12, "hook", "grabbit", hook=True),
    message(13, "ann", "hello all, edited", kind="edit"),
    message(20, "ann", "gra", channel="e"),
    message(21, "bob", "bb", channel="e"),
    message(22, "cat", "it", channel="e"),
]
LIKES = [("s", "ann", "bob", "💗", False, T0 + dt.timedelta(seconds=30)), ("s", "ann", "ann", "💗", False, T0 + dt.timedelta(seconds=30)), ("s", "new", "bob", "💗", False, T0 + dt.timedelta(seconds=30))]


@pytest.fixture(scope="module")
def result(spark):
    m, r, c = spark.createDataFrame(CHAT, S.MESSAGES), spark.createDataFrame(LIKES, S.REACTIONS), spark.createDataFrame([config(["grabbit"])], S.SERVER_CONFIG)
    return {k: v.collect() for k, v in moderate(m, r, c, {"hello": 0.5}, {}).items()}


def test_detections(result):
    got = {r.message_id: (r.phase, r.word, r.punished, r.level_before, r.timed_out) for r in result["detections"]}
    # an obfuscated spelling is reported and not punished; short messages are read with the author's earlier ones
    assert got == {
        2: ("message", "grabbit", True, 0, False),
        3: ("message", "grabbit", False, 1, True),
        6: ("context", "grabbit", True, 0, False),
        7: ("context", "grabbit", True, 1, True),
        8: ("context", "grabbit", True, 2, True),
    }


def test_actions_and_warnings(result):
    seconds = {(r.message_id, r.action): r.seconds for r in result["actions"]}
    assert seconds[2, "punish"] == 0 and (2, "timeout") not in seconds and seconds[3, "timeout"] == 30
    assert len(result["warnings"]) == len(result["detections"])


def test_scores_and_statistics(result):
    scored = {(r.message_id, r.event_kind): r.heat for r in result["scored"]}
    assert (5, "message") not in scored and (9, "message") not in scored and (11, "message") not in scored and (12, "message") not in scored
    assert (10, "message") in scored and (13, "edit") in scored
    # keyword 0.5, no capitals -0.1, no reply -0.1
    assert scored[1, "message"] == pytest.approx(0.3)
    members = {r.author_id: r.message_count for r in result["members"]}
    assert members["ann"] == 5 and members["cat"] == 2


def test_relations(result):
    got = {(r.src_id, r.dst_id): round(r.affection, 6) for r in result["relations"]}
    assert got == {("ann", "bob"): 0.12, ("bob", "ann"): 0.15}


def test_collaborations(result):
    assert [(r.message_id, r.involved_authors) for r in result["collaborations"]] == [(22, ["ann", "bob", "cat"])]


def test_diet_looks_at_the_message_only(spark):
    m, r, c = spark.createDataFrame(CHAT, S.MESSAGES), spark.createDataFrame([], S.REACTIONS), spark.createDataFrame([config(["grabbit"])], S.SERVER_CONFIG)
    out = moderate(m, r, c, {}, {}, diet=True)
    assert "collaborations" not in out and {x.phase for x in out["detections"].collect()} == {"message"}


def test_empty_tables(spark):
    m, r, c = (spark.createDataFrame([], s) for s in (S.MESSAGES, S.REACTIONS, S.SERVER_CONFIG))
    assert {k: v.count() for k, v in moderate(m, r, c, {}, {}).items()} == dict.fromkeys(["detections", "actions", "warnings", "scored", "members", "channels", "alerts", "relations", "collaborations"], 0)


def test_breakdown_adds_up(spark):
    df = spark.createDataFrame([("Hello? If you would, stop!!",), ("",), (None,)], "text string")
    rows = heat_breakdown(df, "text", {"hello": 0.5}, {}).collect()
    r = rows[0]
    assert r.heat == pytest.approx(r.keywords + r.caps + r.length + r.punctuation + r.debate)
    assert rows[1].heat == 0.0


def test_live_plan_equals_the_batch(spark, tmp_path):
    from murmura.streaming import live
    from murmura.streaming.heat import member_stats_stream

    configs = spark.createDataFrame([config(["grabbit"])], S.SERVER_CONFIG)
    want = moderate(spark.createDataFrame(CHAT, S.MESSAGES), spark.createDataFrame([], S.REACTIONS), configs, {}, {})
    rows = sorted(CHAT, key=lambda m: m[5])
    for i in range(0, len(rows), 5):
        spark.createDataFrame(rows[i : i + 5], S.MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        (tmp_path / "in" / "_SUCCESS").unlink()
    messages = spark.readStream.schema(S.MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    heat = messages.withColumn("heat", F.length("content") / 10.0)
    queries = [
        live.start_actions(live.judged_stream(messages, configs), str(tmp_path / "out"), str(tmp_path / "c1")),
        live.start_monitor(member_stats_stream(heat), "author_id", "average_heat", seen.append, str(tmp_path / "c2"), seconds=1),
    ]
    live.stop(*queries)
    columns = ["author_id", "message_id", "action", "seconds"]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/actions")).select(*columns).collect()) == sorted(tuple(r) for r in want["actions"].select(*columns).collect())
    assert spark.read.parquet(str(tmp_path / "out/warnings")).count() == want["warnings"].count()
    ranks = [r[0] for r in seen[-1]]
    assert ranks == sorted(ranks) and {r[1] for r in seen[-1]} == {"ann", "bob", "bot", "cat", "hook"}


def test_affection_on_a_stream(spark, tmp_path):
    from murmura.streaming.live import affection_stream

    spark.createDataFrame(LIKES, S.REACTIONS).write.parquet(str(tmp_path / "in"))
    stream = affection_stream(spark.readStream.schema(S.REACTIONS).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("likes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.src_id, r.dst_id): round(r.affection, 6) for r in spark.table("likes").collect()} == {("ann", "bob"): 0.12, ("new", "bob"): 0.12}
