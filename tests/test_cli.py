import json

from murmura import schemas
from murmura.__main__ import main
from tests.test_moderate import CHAT, OFF


def test_keyspace(capsys):
    main(["keyspace", "grabbit"])
    assert "'grammar': 8" in capsys.readouterr().out


def test_check_and_archives(spark, tmp_path, capsys):
    (tmp_path / "kw.json").write_text(json.dumps({"keywords": [{"word": "hot", "heat": 0.5}], "safeWords": []}))
    (tmp_path / "a.txt").write_text("[2024-01-01 00:00:00] ann: so hot\n[2024-01-01 00:00:01] bob: Fine, thanks.\nbroken\n")
    main(["--keywords", str(tmp_path / "kw.json"), "check", "so hot"])
    assert "0.4" in capsys.readouterr().out
    main(["--keywords", str(tmp_path / "kw.json"), "analyze-archive", str(tmp_path / "a.txt")])
    out = capsys.readouterr().out
    assert "median" in out and out.count("●") == 2
    main(["clean-archive", str(tmp_path / "a.txt"), str(tmp_path / "out")])
    assert "removed_percent" in capsys.readouterr().out


def test_relations_and_monitor(spark, tmp_path, capsys):
    member = lambda n, h, r: {"memberName": n.upper(), "memberId": n, "averageHeatLevel": h, "relations": r}
    stats = {
        "serverName": "one", "serverId": "1", "channels": {"c": {"channelName": "general", "channelId": "c", "averageHeatIndex": 0.5}},
        "members": {"a": member("a", 0.2, [{"targetMemberId": "b", "affection": 6.0}]), "b": member("b", 0.1, [])},
    }
    (tmp_path / "s.json").write_text(json.dumps(stats))
    main(["relations", str(tmp_path / "s.json"), "--server", "1"])
    assert "one-sided" in capsys.readouterr().out
    main(["monitor", str(tmp_path / "s.json"), "1"])
    out = capsys.readouterr().out
    assert out.index("|B ") < out.index("|A ") and "general" in out


def test_messages_modes(spark, tmp_path, capsys):
    src = str(tmp_path / "in")
    spark.createDataFrame(CHAT, schemas.MESSAGES).write.parquet(src)
    (tmp_path / "conf").mkdir()
    config = {**OFF, "delete_filtered_messages": True, "timeout_for_filtered_messages": True, "warning_channel_id": "wa", "alert_channel_id": "al", "timeout_base_seconds": 30, "banned_words": ["grabbit"]}
    (tmp_path / "conf/s.json").write_text(json.dumps({"name": "one", "id": "s", "config": config}))
    main(["archive", src, str(tmp_path / "a")])
    assert spark.read.text(str(tmp_path / "a")).count() == len(CHAT)
    main(["benchmark", src, "grabbit"])
    out = capsys.readouterr().out
    assert "live: 16 messages" in out and "multipass: 16 messages" in out
    main(["benchmark", src, "grabbit", "--token", "grabbit"])
    assert "live: 3 messages" in capsys.readouterr().out
    main(["moderate", src, str(tmp_path / "conf"), str(tmp_path / "out"), "--debug"])
    actions = spark.read.parquet(str(tmp_path / "out/actions"))
    assert spark.read.parquet(str(tmp_path / "out/breakdown")).count() == len(CHAT) and actions.count() > 5
    main(["moderate", src, str(tmp_path / "conf"), str(tmp_path / "diet"), "--diet"])
    assert not (tmp_path / "diet/collaborations").exists()
    main(["live", src, str(tmp_path / "conf"), str(tmp_path / "live"), str(tmp_path / "cp"), "--once"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "live/actions")).select(*actions.columns).collect())) == sorted(map(tuple, actions.collect()))
    assert spark.read.json(str(tmp_path / "live/members")).count() == 3
