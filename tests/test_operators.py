"""Detectors, folds, relations, files and the stream."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions import patterns
from murmura.functions.normalize import normalizer
from murmura.operators import archive, context, detect, folds, moderation, stats
from murmura.sources import files

WORD = "grabbit"


def found(spark, texts, word=WORD):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.found for r in detect.multipass(df, "text", word).orderBy("id").collect()]


def test_multipass_catches_disguises(spark):
    texts = ["grabbit", "GRABBIT.", "g r a b b i t", "gr4bb1t", "g-r-a-b-b-i-t", "g.r.a.b.b.i.t", "g_r_a_b_b_i_t", "g/r/a/b/b/i/t", "g:r:a:b:b:i:t", "𝗴𝗿𝗮𝗯𝗯𝗶𝘁", "grabblt", "g♥r♥a♥b♥b♥i♥t", "grabbits", "grabbiting"]
    assert found(spark, texts) == [True] * len(texts)


def test_multipass_leaves_clean_text_alone(spark):
    texts = ["a rabbit", "ungrabbitable", "grab it", "grabbitt", "", "bitgrab", "hello there", None, "grab\nbitter"]
    assert found(spark, texts) == [False] * len(texts)


def test_multipass_decodes(spark):
    import base64

    hidden = "look at this text here please: " + base64.b64encode(b"say grabbit now then").decode()
    bits = "and some binary digits follow now: " + "".join(f"{c:08b}" for c in b"grabbit")
    assert found(spark, [hidden, bits, "x" * 60, "1" * 64]) == [True, True, False, False]


def test_keyword_rules(spark):
    heats, safe = {"hot": 0.5, "hot take": 0.3, "fr fr": 0.1}, {"calm": -0.4}
    cases = [("hot", 0.5), ("hot hot", 1.0), ("hot take", 0.8), ("hotter", 0.2), ("hotter shot", 0.2), ("xhoty", 0.0), ("hot hotter", 0.5), ("calm", 0.0), ("hot calm", 0.1), ("fr fr fr", 0.2), ("", 0.0)]
    df = spark.createDataFrame(cases, "t string, want double")
    for r in df.withColumn("got", detect.keyword_heat(F.col("t"), heats, safe)).collect():
        assert r.got == pytest.approx(r.want), r.t


def test_first_match_takes_configured_order(spark):
    rows = patterns.pattern_rows(["zebra", "apple"], normalizer())
    df = spark.createDataFrame([("apple zebra",), ("z e b r a",), ("apples",), ("pineapple",), (None,)], "t string")
    assert [r[0] for r in df.select(detect.first_match(F.col("t"), rows)).collect()] == ["zebra", "zebra", "apple", None, None]


def test_equal_spellings_report_the_last_original():
    rows = patterns.pattern_rows(["Grab", "GR4B"], normalizer())
    assert [(w, i) for _, w, i in rows] == [("GR4B", 0)]


def test_reply_chains(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99)]
    df = spark.createDataFrame(rows, "message_id bigint, reply_to_message_id bigint")
    assert dict(tuple(r) for r in context.reply_depth(df).collect()) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 1}


def series(spark, heats):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", "c", i, start + dt.timedelta(seconds=20 * i), h) for i, h in enumerate(heats)]
    return spark.createDataFrame(rows, "server_id string, channel_id string, message_id bigint, ts timestamp, heat double")


def test_channel_heat_by_hand(spark):
    got = folds.channel_heat(series(spark, [0.0, 1.0, 0.5, 2.0, 2.0, 2.0, 2.0]), ["channel_id"], ["ts", "message_id"]).orderBy("message_id").collect()
    assert [round(r.average, 6) for r in got[:4]] == [0.0, 1.0, 0.75, 1.6875]
    assert [r.alert for r in got] == [False, False, False, False, True, False, False]


def test_channel_heat_of_null_and_empty(spark):
    got = folds.channel_heat(series(spark, [1.0, None, 0.5]), ["channel_id"], ["ts", "message_id"]).orderBy("message_id").collect()
    assert [r.average for r in got] == [1.0, 1.0, 0.75]
    assert folds.channel_heat(series(spark, [1.0]).where("false"), ["channel_id"], ["ts", "message_id"]).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from murmura.streaming.heat import channel_heat_stream

    heats = [(i * 37 % 23) / 10 for i in range(60)]
    df = series(spark, heats).withColumn("channel_id", F.when(F.col("message_id") % 3 == 0, "a").otherwise("b"))
    want = {r.message_id: (round(r.average, 9), r.samples, r.alert) for r in folds.channel_heat(df, ["channel_id"], ["ts", "message_id"], cooldown=60).collect()}
    for i in range(3):
        df.where(f"message_id >= {20 * i} and message_id < {20 * i + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = channel_heat_stream(stream, 60).writeStream.format("memory").queryName("heat_stream").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.message_id: (round(r.average, 9), r.samples, r.alert) for r in spark.table("heat_stream").collect()}
    assert got == want


def test_thinning(spark):
    times = {"a": [0, 10, 59, 60, 100, 121], "b": [5], None: [7, 8, 90]}
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), t, "x") for k, ts in times.items() for t in ts] + [("a", None, -1, "x")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, t int, _state string")
    got = {}
    for r in folds.thinned(df, ["k"], ["ts"], 60).orderBy("t").collect():
        got.setdefault(r.k, []).append(r.t)
    assert got == {"a": [0, 60, 121], "b": [5], None: [7, 90]}
    assert folds.thinned(df.where("false"), ["k"], ["ts"], 60).count() == 0


def test_first_offence_is_never_timed_out(spark):
    rows = [(i, "s", "u", "a grabbit", "grabbit", "grabbit", i, "flat", 60, True, True, "w") for i in range(2)]
    names = "message_id bigint, server_id string, author_id string, shown string, word string, spelling string, level_before int, timeout_mode string, timeout_base_seconds int, timeout_for_filtered_messages boolean, delete_filtered_messages boolean, warning_channel_id string"
    judged = moderation.violations(spark.createDataFrame(rows, names))
    got = sorted(tuple(r) for r in moderation.actions(judged).select("message_id", "action", "seconds").collect())
    assert got == [(0, "delete", 0), (0, "punish", 0), (1, "delete", 0), (1, "punish", 0), (1, "timeout", 60)]
    assert sorted(r.timeout or "" for r in moderation.warnings(judged).collect()) == ["", "1m"]


def test_relations(spark):
    r = spark.createDataFrame([("s", "a", "b", 6.0), ("s", "b", "a", 7.0), ("s", "a", "c", 9.0), ("s", "c", "d", -6.0), ("s", "a", "gone", 9.0)], "server_id string, src_id string, dst_id string, affection double")
    m = spark.createDataFrame([("s", x) for x in "abcd"], "server_id string, member_id string")
    got = sorted((x.src_id, x.dst_id, x["class"]) for x in stats.classified_relations(r, m).collect())
    assert got == [("a", "b", "mutual"), ("a", "c", "one-sided"), ("b", "a", "mutual"), ("c", "d", "negative")]


def test_archive_lines(spark):
    lines = ["[2024-01-01 00:00:00] ann: hi: there", "", "no bracket: here", "late: x] y", "[t] bob: is it? really? yes. \"a\" \"b\" however"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    assert [r.message for r in archive.replayed(df).orderBy("line_no").collect()] == ["hi: there", 'is it? really? yes. "a" "b" however']
    scored = archive.scored_lines(df)
    assert [r.kept for r in scored.orderBy("line_no").collect()] == [True, True, True, True, False]
    assert tuple(archive.cleaning_report(scored).first()) == (5, 1, 1, 20.0)


def test_quartiles_take_the_lower_rank(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4, 10)] + [("one", 5.0)], "k string, v double")
    got = {r.k: r for r in archive.order_statistics(df, "v", ["k"]).collect()}
    assert (got["k"].q1, got["k"].median, got["k"].q3, got["k"].iqr) == (2.0, 3.0, 4.0, 2.0)
    assert (got["one"].q1, got["one"].deviation) == (5.0, 0.0)


def test_order_statistics_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {k: rng.integers(0, 4, n) / 2 for k, n in (("a", 1), ("b", 2), ("c", 7), ("d", 400))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    got = {r.k: r for r in archive.order_statistics(df, "v", ["k"]).collect()}
    for k, vs in data.items():
        low = np.sort(vs)
        assert (got[k].n, got[k].median, got[k].q1, got[k].q3) == (len(vs), np.median(vs), low[int(0.25 * (len(vs) - 1))], low[int(0.75 * (len(vs) - 1))])


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_graph_renders_any_length(n):
    text = archive.line_graph([float(i) for i in range(n)])
    assert text.count("●") == n


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "kw.json").write_text(json.dumps({"keywords": [{"word": "hot", "heat": 0.5}], "safeWords": [{"word": "calm", "heat": -0.2}]}))
    assert files.keyword_maps(files.keywords(spark, str(tmp_path / "kw.json"))) == ({"hot": 0.5}, {"calm": -0.2})
    conf = tmp_path / "conf"
    conf.mkdir()
    (conf / "1.json").write_text(json.dumps({"name": "one", "id": "1", "config": {"banned_words": ["grabbit"]}}))
    (conf / "2.json").write_text("{ broken")
    configs = files.server_configs(spark, str(conf))
    row = configs.select("id", files.setting("timeout_mode").alias("m"), files.setting("banned_words").alias("w")).collect()
    assert [tuple(r) for r in row] == [("1", "flat", ["grabbit"])]
    servers = spark.createDataFrame([("one", "1"), ("two", "2")], "name string, id string")
    assert [r.id for r in files.default_configs(servers, configs, ["w"]).collect()] == ["2"]


def test_snapshot_round_trip(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({
        "serverName": "one", "serverId": "1", "totalMessagesAnalyzed": 3, "totalInfractions": 0,
        "channels": {"c": {"channelName": "general", "channelId": "c", "averageHeatIndex": 0.5}},
        "members": {"a": {"memberName": "Ann", "memberId": "a", "averageHeatLevel": 0.4, "relations": [{"targetMemberId": "b", "affection": 1.5}]}, "b": {"memberName": "Bob", "memberId": "b", "messageCount": 2}},
    }))
    tables = files.stats_snapshot(spark, str(tmp_path / "s.json"))
    assert {r.memberId: r.messageCount for r in tables["members"].collect()} == {"a": 1, "b": 2}
    files.write_snapshot(tables, str(tmp_path / "out"))
    again = files.stats_snapshot(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in again["relations"].collect()] == [("1", "a", "b", 1.5)]
    named = {r.memberId: r.relations for r in files.readable_stats(spark, str(tmp_path / "s.json")).collect()}
    assert named["a"][0]["targetMemberName"] == "Bob" and named["b"] is None


def test_archive_files(spark, tmp_path):
    rows = [(2, dt.datetime(2024, 1, 2), "bob", "two"), (1, dt.datetime(2024, 1, 1), "ann", "one")]
    m = spark.createDataFrame(rows, "message_id int, ts timestamp, author_name string, content string")
    files.write_archive(m, str(tmp_path / "a"))
    back = archive.replayed(files.archive_lines(spark, str(tmp_path / "a"))).orderBy("line_no").collect()
    assert [r.message for r in back] == ["one", "two"]


def test_history_on_a_stream_equals_the_window(spark, tmp_path):
    from murmura.streaming.history import with_history_stream

    rows = [("message", "s", f"c{i % 2}", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), f"u{i % 3}", False, False, "TEXT", f"m{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "event_kind string, server_id string, channel_id string, message_id bigint, ts timestamp, author_id string, is_bot boolean, is_webhook boolean, channel_type string, content string")
    want = {r.message_id: r.context for r in context.with_context(df).collect()}
    for i in range(2):
        df.where(f"message_id >= {20 * i} and message_id < {20 * i + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = context.contextual(with_history_stream(stream)).select("message_id", "context")
    q = live.writeStream.format("memory").queryName("history_stream").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.message_id: r.context for r in spark.table("history_stream").collect()} == want


def test_reply_depth_of_long_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(2500)] + [(3000, 3001), (3001, 3000), (3002, 3001)]
    got = dict(tuple(r) for r in context.reply_depth(spark.createDataFrame(rows, "message_id long, reply_to_message_id long")).collect())
    assert len(got) == len(rows) and all(got[i] == i for i in range(2500))
