"""Sources, ingest, rollups, streaming and the envelope on small files."""

import json

import pytest
from pyspark.sql import functions as F

from annalist.ingest import Options, Relation, ingest
from annalist.model import Store, as_events
from annalist.operators import counting, relations
from annalist.operators.scope import Scope
from annalist.plans import envelope, rollups
from annalist.sources import commands, jsonl, registry, text
from annalist.sources.lines import read_lines
from annalist.streaming.ingest import History, line_stream, tail, windowed_counts


def lines(spark, tmp_path, content, name="x.log"):
    (tmp_path / name).write_text(content)
    return read_lines(spark, str(tmp_path / name))


def got(df, *columns):
    return [tuple(r) for r in df.orderBy("place").select(*columns).collect()]


def test_jsonl(spark, tmp_path):
    content = "\n".join(
        [
            json.dumps({"ts": 1700000000123, "level": "warn", "msg": "a\nb", "service": "api", "x": {"y": 1}, "n": 5, "host": "h"}),
            json.dumps({"timestamp": "2024-01-01T00:00:00Z", "severity": "error", "message": "boom", "logger": "db"}),
            json.dumps({"a.b": "literal", "a": {"b": "path"}, "when": "never"}),
            "not json",
            "[1, 2]",
        ]
    )
    df = jsonl.parse(lines(spark, tmp_path, content))
    assert got(df, "at_ms", "title", "level", F.col("touches")[0]["entity"]) == [(1700000000123, "a", "WARN", "api"), (1704067200000, "boom", "ERROR", "db"), (0, "{a,a.b,when}", "", "unknown")]
    first = df.orderBy("place").first()
    assert first["body"] == "a\nb" and first["attrs"]["n"] == "5" and "x" not in first["attrs"]
    assert df.select("id").distinct().count() == 3
    picked = jsonl.parse(lines(spark, tmp_path, content), jsonl.Fields(attrs=("a.b",), message="when"))
    assert got(picked.where("title = 'never'"), F.col("attrs")["a.b"]) == [("literal",)]


def test_jsonl_explode_where_links(spark, tmp_path):
    line = {"ts": 1700000000, "sid": "s1", "items": [{"type": "use", "id": "u1", "text": "go"}, {"type": "skip"}, {"type": "use", "text": "on", "sub": [{"k": 1}, {"v": "deep"}]}]}
    fields = jsonl.Fields(explode="items", explode_where=("type=use|other",), links=(("session", "sid"),), attrs=("sub[].v",), level_map={"x": "y"})
    df = jsonl.parse(lines(spark, tmp_path, json.dumps(line)), fields)
    assert got(df, "title", F.col("links")[0]["target"], F.col("attrs")["sub[].v"]) == [("go", "s1", None), ("on", "s1", "deep")]
    assert "u1" in {r[0] for r in df.select("id").collect()}


def test_jsonl_entity_join(spark, tmp_path):
    content = "\n".join(json.dumps(x) for x in [{"msg": "1", "key": "k", "service": "api"}, {"msg": "2", "key": "k"}, {"msg": "3", "key": "other"}])
    df = jsonl.parse(lines(spark, tmp_path, content), jsonl.Fields(entity_join="key"))
    assert got(df, "title", F.col("touches")[0]["entity"]) == [("1", "api"), ("2", "api"), ("3", "unknown")]


def test_transcripts(spark, tmp_path):
    use = {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "message": {"content": [{"type": "tool_use", "id": "u1", "name": "sh", "input": {"file_path": "a.py"}}, {"type": "text"}]}}
    result = {"type": "user", "timestamp": "2024-01-01T00:00:01Z", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "is_error": True, "content": "no such file\nx"}]}}
    df = jsonl.parse(lines(spark, tmp_path, "\n".join(json.dumps(x) for x in [use, result, {"type": "other"}])), jsonl.TRANSCRIPTS)
    got_ = {r["kind"]: r for r in df.collect()}
    assert set(got_) == {"tool_use", "tool_result"} and got_["tool_result"]["title"] == "no such file" and got_["tool_result"]["level"] == "ERROR"
    assert {(x["rel"], x["target"]) for x in got_["tool_use"]["links"]} == {("tool_use", "u1"), ("file", "a.py")}
    s = ingest(df, Options(entity_via="tool_use", dims=("sessionId",)))
    assert sorted(r["entity"] for r in s.touches.collect()) == ["sh", "sh"]


def test_csv(spark, tmp_path):
    df = text.csv(lines(spark, tmp_path, 'ts,msg,service,level\n1700000000,"a, ""b""",api,warn\n2024-01-01T00:00:00Z,short\n'), "ts,msg,service,level")
    assert got(df, "at_ms", "title", "level", F.col("touches")[0]["entity"]) == [(1700000000000, 'a, "b"', "WARN", "api"), (1704067200000, "short", "", "unknown")]


def test_syslog_and_access(spark, tmp_path):
    df = text.syslog(lines(spark, tmp_path, "<34>1 2024-01-01T00:00:00Z host app 12 - - hello\nJan  2 03:04:05 box sshd[7]: bye\nnoise\n"), year=2024)
    assert got(df, "at_ms", "title", "level", F.col("touches")[0]["entity"]) == [(1704067200000, "hello", "CRIT", "app"), (1704164645000, "bye", "", "sshd")]
    df = text.access(lines(spark, tmp_path, '1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /x?a=1 HTTP/1.1" 503 10 "ref" "ua"\n'))
    assert got(df, "at_ms", "title", "level", "actor", F.col("touches")[0]["entity"], F.col("attrs")["agent"]) == [(971211336000, "GET /x?a=1 503", "ERROR", "1.2.3.4", "/x", "ua")]


def test_template(spark, tmp_path):
    df = text.templated(lines(spark, tmp_path, "1700000000  warn [api] it: works\nother\n"), "<time> <level> [<svc>] <key>: <message>")
    assert got(df, "at_ms", "level", "title", F.col("touches")[0]["entity"], F.col("attrs")["key"]) == [(1700000000000, "WARN", "works", "api", "it")]
    for bad in ("no fields", "<a> <a>"):
        with pytest.raises(ValueError):
            text.template_regex(bad)


def test_changelog_journal_git_nod_jobs(spark, tmp_path):
    log = "# Changes\n## [1.1.0] - 2024-06-02\n### Added\n- a\n- b\n### Fixed\n- c\n## [1.0.0] - 2024-06-01\n## 1.0.0\n### Added\n- x\n"
    whole = spark.createDataFrame([("C.md", 0, log)], "file string, place long, line string")
    df = text.changelog(whole)
    assert got(df, "title", "at_ms", F.transform("touches", lambda t: F.concat(t["entity"], t["weight"].cast("string")))) == [("1.1.0", 1717286400000, ["added2", "fixed1"]), ("1.0.0", 1717200000000, []), ("1.0.0", 0, ["added1"])]
    assert df.select("id").distinct().count() == 3
    j = text.journal(lines(spark, tmp_path, json.dumps({"MESSAGE": "m", "PRIORITY": "3", "__REALTIME_TIMESTAMP": "1700000000000000", "SYSLOG_IDENTIFIER": "cron"})))
    assert got(j, "at_ms", "level", "title") == [(1700000000000, "ERROR", "m")]
    commit = "\x1f".join(["a" * 40, "Ann", "ann@x", "1700000000", "iso", "fix: y #7", "This reverts commit abcdef1.\n", "\n1\t2\tsrc/{old => new}/f.py\n-\t-\tp.png\n"])
    (tmp_path / "git.log").write_text("\x1e" + commit)
    g = text.git_log(commands.commits(spark, str(tmp_path / "git.log"))).first()
    assert [(t["entity"], t["added"], t["deleted"], t["weight"]) for t in g["touches"]] == [("src/new/f.py", 1, 2, 3), ("p.png", -1, -1, 0)]
    assert [(x["rel"], x["target"]) for x in g["links"]] == [("ticket", "#7"), ("reverts", "abcdef1")] and g["actor"] == "ann@x"
    nod = {"nod": 1, "source": {"instance": "i", "run": "r"}, "events": [{"seq": 1, "ts": "2024-01-01T00:00:00Z", "type": "tool.result", "session": "s", "data": {"tool": "sh", "ok": "false", "commit": "abc", "session": "clash"}}]}
    n = text.envelopes(lines(spark, tmp_path, json.dumps(nod))).first()
    assert (n["id"], n["kind"], n["level"], n["attrs"]["session"], n["attrs"]["data.session"], n["touches"][0]["entity"]) == ("nod:i:r:1", "nod.tool.result", "ERROR", "s", "clash", "tool/sh")
    meta = spark.createDataFrame([("j1", "started=2024-01-01T00:00:00Z\nended=2024-01-01T01:00:00Z\nowner=ann\nsha=abc", 0)], "job string, line string, place long")
    audit = lines(spark, tmp_path, json.dumps({"ts": "2024-01-01T02:00:00Z", "event": "merged", "job": "j1", "cost_usd": 1.5}))
    d = text.jobs(meta, audit)
    assert sorted(r[0] for r in d.select("kind").collect()) == ["delega.audit.merged", "delega.job.end", "delega.job.start"]


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.jpg").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "b.txt").write_text("hi")
    df = text.directory(spark, str(tmp_path), str(tmp_path))
    assert sorted((r["title"], r["attrs"]["format"], r["attrs"]["ext_mismatch"], r["touches"][0]["entity"]) for r in df.collect()) == [("b.txt", "", "false", "."), ("sub/a.jpg", "png", "true", "sub")]


def test_registry():
    assert registry.pick("a.jsonl", ['{"ts": 1}']) == "jsonl"
    assert registry.pick("a.jsonl", ['{"nod": 1, "events": []}']) == "nod"
    assert registry.pick("a.csv", ["a,b"]) == "csv"
    assert registry.pick("x/.git", []) == "git"
    assert registry.pick("CHANGELOG.md", ["## [1.0]"]) == "changelog"
    assert registry.pick("m.log", ["Jan  2 03:04:05 box sshd[7]: bye"]) == "textlog"
    assert registry.pick("whatever", ["?"]) == "dir"


def test_commands(tmp_path):
    assert commands.extracted('{"a": {"b": [{"x": 1}, 2]}}', "a.b") == [{"x": 1}]
    assert commands.extracted('{"x": 1}\n{"x": 2}') == [{"x": 1}, {"x": 2}]
    path = str(tmp_path / "cache.jsonl")
    assert commands.land([{"id": 1, "v": 1}, {"id": 2}], path, "id") == 2 and commands.land([{"id": 1, "v": 9}, {"id": 3}], path, "id") == 1
    assert commands.run(["printf", "hi"]) == "hi"
    with pytest.raises(RuntimeError):
        commands.run(["false"])


def test_issues(spark, tmp_path):
    rows = lines(spark, tmp_path, "\n".join(json.dumps(x) for x in [{"number": 1, "title": "old", "state": "OPEN", "labels": []}, {"number": 1, "title": "new", "state": "MERGED", "mergedAt": "2024-01-01T00:00:00Z", "labels": [{"name": "bug"}]}]))
    r = commands.issues(rows, "pr").first()
    assert (r["title"], r["state"], r["merged"], r["is_bug"], r["closed_at"]) == ("new", "merged", True, True, 1704067200000)


def test_ingest(spark, tmp_path):
    content = "\n".join(json.dumps(x) for x in [
        {"id": "1", "ts": 1700000000, "msg": "ERROR: password=correcthorse9 PR-12", "service": "api", "host": "h1", "req": "r9"},
        {"id": "1", "ts": 1700000009, "msg": "again", "service": "late"},
        {"id": "2", "ts": 1700000001, "msg": "quiet", "req": "r9", "token": "abcdefgh"},
    ])
    records = jsonl.parse(lines(spark, tmp_path, content), jsonl.Fields(links=(("req", "req"),)))
    s = ingest(records, Options(dims=("host",), entity_via="req", relations=(Relation("pr", "title", pattern=r"PR-(\d+)"),)))
    rows = s.events.orderBy("rid").collect()
    assert [r["title"].split()[0] for r in rows] == ["ERROR:", "quiet"] and "correcthorse9" not in rows[0]["title"]
    assert rows[0]["dims"] == {"host": "h1"} and rows[0]["level_inf"] == "ERROR" and rows[0]["level"] == "" and rows[1]["attrs"]["token"] == "<SECRET>"
    assert sorted(tuple(r) for r in s.links.select("rel", "target").collect()) == [("pr", "12"), ("req", "r9"), ("req", "r9")]
    assert {r["entity"] for r in s.touches.collect()} == {"api"}
    assert [r["id"] for r in relations.sharing(s, rows[0]["id"], "req").collect()] == [rows[1]["id"]]


def test_rules(spark):
    commit = spark.createDataFrame([(1, "commit", "fix(core): memory leak in build", ""), (2, "commit", "add feature", ""), (3, "log", "fix", "")], "rid long, kind string, title string, body string")
    from annalist.ingest import labels_of

    got = {(r["rid"], r["task"]): (r["label"], r["confidence"]) for r in labels_of(commit, Options()).collect()}
    assert got == {(1, "kind"): ("fix", 1.0), (1, "is_fix"): ("true", 1.0), (1, "bug_category"): ("memory-safety", 0.7), (2, "is_fix"): ("false", 1.0)}


def _events(spark, n):
    rows = spark.range(n).select((F.col("id") + 1).alias("rid"), F.concat(F.lit("e"), "id").alias("id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") * 70_000 % 5_000_000).alias("at_ms"), F.when(F.col("id") % 4 == 0, "ERROR").otherwise("INFO").alias("level"))
    return as_events(rows)


def test_rollups_equal_the_events(spark):
    s = Store.of(_events(spark, 400))
    cube = rollups.build(s)
    for scope in (Scope(), Scope(since=600_000), Scope(level="ERROR"), Scope(since=600_000, until=3_000_000, kind="b"), Scope(since=601_000)):
        for dim in ("level", "kind"):
            assert rollups.top_from(cube, s, dim, scope).collect() == counting.top(s, dim, scope).collect()
    half = Store.of(_events(spark, 200))
    rest = Store.of(_events(spark, 400).where("rid > 200"))
    assert sorted(rollups.merge(rollups.build(half), rollups.build(rest)).collect()) == sorted(cube.collect())
    assert rollups.top_from(rollups.build(half), s, "level").collect() == counting.top(s, "level").collect()  # stale


def test_streaming(spark, tmp_path):
    inbox, home = tmp_path / "in", tmp_path / "history"
    inbox.mkdir()
    write = lambda name, xs: (inbox / name).write_text("\n".join(json.dumps(x) for x in xs) + "\n")
    write("1.jsonl", [{"id": "a", "ts": 1700000000, "msg": "one"}, {"id": "b", "ts": 1700000001, "msg": "two"}])
    h = History(spark, str(home))
    go = lambda: h.follow(line_stream(spark, str(inbox)), jsonl.parse, str(tmp_path / "cp")).awaitTermination()
    go()
    write("2.jsonl", [{"id": "b", "ts": 9, "msg": "again"}, {"id": "c", "ts": 1700000002, "msg": "three"}])
    go()
    go()
    rows = h.table("events").orderBy("rid").collect()
    assert sorted(r["title"] for r in rows) == ["one", "three", "two"] and len({r["rid"] for r in rows}) == 3
    h.append(jsonl.parse(read_lines(spark, str(inbox / "2.jsonl"))), 1)  # a replayed batch changes nothing
    assert sorted(r["title"] for r in h.table("events").collect()) == ["one", "three", "two"]
    h.remove("jsonl")
    assert not h.table("events").count() and not h.table("touches").count()


def test_tail_and_windows(spark, tmp_path):
    _events(spark, 50).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(_events(spark, 1).schema).parquet(str(tmp_path / "ev"))
    shown = []
    tail(stream, Scope(level="ERROR"), shown.extend, str(tmp_path / "cp1")).awaitTermination()
    assert [r["id"] for r in shown] == [r["id"] for r in _events(spark, 50).where("level = 'ERROR'").orderBy("at_ms", "id").collect()]
    q = windowed_counts(stream, "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("count")).first()[0] == 50


def test_envelope(spark):
    out = envelope.answer(spark.range(5).orderBy("id"), "ids", 3, since=0, until=9)
    assert out["budget"] == {"max_items": 3, "returned": 3, "truncated": True} and out["window"] == {"until": 9}
    assert envelope.compact([{"a": 1.23456, "b": "x\ty"}, {"a": None, "b": [1]}]) == "a\tb\n1.235\tx y\n\t[1]"


def test_command_line(spark, tmp_path):
    from annalist.__main__ import main

    _events(spark, 40).write.parquet(str(tmp_path / "h/events"))
    out = json.loads(main(["top", str(tmp_path / "h"), "level", "--limit", "1"], spark))
    assert out["result"] == [{"value": "INFO", "count": 30}] and out["budget"]["truncated"]
    assert main(["top", str(tmp_path / "h"), "kind", "--level", "error", "--compact"], spark) == "value\tcount\nb\t6\na\t4"
    assert json.loads(main(["hotspots", str(tmp_path / "h")], spark))["result"] == []
    with pytest.raises(ValueError):
        main(["top", str(tmp_path / "h"), "level", "--attr", "novalue"], spark)


def test_tags_and_tree_of_a_repository(spark, tmp_path):
    repo = tmp_path / "repo"
    git = ["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c"]
    commands.run(["git", "init", "-q", str(repo)])
    (repo / "a b.txt").write_text("1\n2\n3\n")
    (repo / "é.txt").write_text("1\n")
    (repo / "bin").write_bytes(b"\0\1\n\2")
    commands.run([*git, "add", "-A"])
    commands.run([*git, "commit", "-qm", "one"])
    commands.run([*git, "tag", "v1"])
    commands.land_tree(str(repo), str(tmp_path / "landed"))
    (mark,) = commands.tags(read_lines(spark, str(tmp_path / "landed" / "tags.txt")), "git:r").collect()
    assert (mark["source"], mark["name"], mark["kind"]) == ("git:r", "v1", "tag") and mark["at_ms"] > 0 and mark["ref"]
    known = [("a b.txt", "file", 9, True, False), ("é.txt", "file", 0, False, False), ("bin", "file", 7, False, True), ("gone", "file", 5, False, False), ("svc", "service", 2, False, False)]
    entities = spark.createDataFrame(known, "entity string, type string, size long, deleted boolean, excluded boolean")
    out = commands.sized(entities, read_lines(spark, str(tmp_path / "landed" / "tree.txt")))
    assert {r[0]: r[1:] for r in map(tuple, out.collect())} == {"a b.txt": ("file", 3, False, False), "é.txt": ("file", 1, False, False), "bin": ("file", 0, False, True), "gone": ("file", 5, True, False), "svc": ("service", 2, False, False)}


def test_closest(spark):
    names = spark.createDataFrame([("hotspots",), ("Hotspot",), ("coupling",), (None,), ("hotspots",)], "value string")
    assert [tuple(r) for r in counting.closest(names, "hotspotz").collect()] == [("Hotspot", 1), ("hotspots", 1)]
    assert not counting.closest(names, "zzz").collect()
