import json
import os

import pytest
from pyspark.sql import functions as F

from annalist.ingest import chained
from annalist.operators import counting, search
from annalist.operators.scope import Scope
from annalist.plans import envelope, rollups
from annalist.sources import jsonl
from annalist.sources.lines import read_lines
from annalist.streaming.ingest import History
from annalist.streaming.sync import Feed, Synced, sync


def put(path, *rows, end="\n", at=0):
    path.write_text("\n".join(json.dumps(x) if isinstance(x, dict) else x for x in rows) + end)
    os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))


def row(k, msg):
    return {"ts": 1_700_000_000 + k, "msg": msg, "level": "info", "service": "s"}


def titles(h):
    return sorted(r["title"] for r in h.table("events").collect())


def agree(h):
    """What is kept beside the events says what they say."""
    s = h.store()
    assert rollups.top_from(h.rollups(), s, "level").collect() == counting.top(s, "level").collect()
    texts = s.events.select("rid", F.concat_ws(" ", "title", "body").alias("text"))
    for query in (["one"], ["two", "x"], ["nothing"]):
        assert [tuple(r) for r in h.search(query, 25).collect()] == [tuple(r) for r in search.bm25(texts, query, 25).collect()]
    rids = {r[0] for r in s.events.select("rid").collect()}
    assert {r[0] for r in h.table("touches").select("rid").collect()} <= rids and {r[0] for r in h.table("lengths").select("rid").collect()} == rids


def test_sync(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b[1]"
    for x in (a, b):
        x.mkdir()
    put(a / "1.jsonl", row(1, "one x"), row(2, "two x"))
    put(a / "2.jsonl", row(3, "three"))
    put(b / "1.jsonl", row(1, "one x"))
    h = History(spark, str(tmp_path / "h"))
    feeds = [Feed("a", f"{a}/*.jsonl", jsonl.parse), Feed("none", str(tmp_path / "nowhere"), jsonl.parse), Feed("b", str(b).replace("[", "\\[").replace("]", "\\]"), jsonl.parse)]
    first = sync(h, feeds, most=1)
    assert [(x.name, x.read, x.gone) for x in first] == [("a", 2, 0), ("none", 0, 0), ("b", 1, 0)]
    assert not first[0].error and "PATH_NOT_FOUND" in first[1].error
    assert titles(h) == ["one x", "one x", "three", "two x"]  # equal lines of two files are two events
    agree(h)
    assert sync(h, feeds[:1]) == [Synced("a")]
    put(a / "1.jsonl", row(1, "one x"), row(2, "two x"), row(4, "four"), '{"ts": 17000', end="", at=1)  # grown, last line incomplete
    put(a / "2.jsonl", row(3, "two x three"), at=1)  # rewritten
    assert sync(h, feeds[:1]) == [Synced("a", 2)]
    assert titles(h) == ["four", "one x", "one x", "two x", "two x three"]
    agree(h)
    (a / "2.jsonl").unlink()
    assert sync(h, feeds[:1]) == [Synced("a", 0, 1)]
    assert titles(h) == ["four", "one x", "one x", "two x"]
    agree(h)


def test_failing_parser_and_lock(spark, tmp_path):
    (tmp_path / "a").mkdir()
    put(tmp_path / "a" / "1.jsonl", row(1, "one"))
    h = History(spark, str(tmp_path / "h"))

    def fails(lines):
        raise ValueError("no such format")

    good = Feed("good", str(tmp_path / "a"), jsonl.parse)
    assert [x.error for x in sync(h, [Feed("bad", str(tmp_path / "a"), fails), good])] == ["ValueError: no such format", ""]
    assert titles(h) == ["one"]
    with h.locked(), pytest.raises(RuntimeError):
        sync(h, [good])
    assert sync(h, [good]) == [Synced("good")]


def test_rewrite_that_was_cut_short(spark, tmp_path):
    put(tmp_path / "1.jsonl", row(1, "one"), row(2, "two"))
    h = History(spark, str(tmp_path / "h"))
    h.append(jsonl.parse(read_lines(spark, str(tmp_path / "1.jsonl"))), 0)
    h.remove("no such source")  # writes every table anew
    os.rename(tmp_path / "h" / "events", tmp_path / "h" / "events.new")  # the driver was lost between two renames
    assert titles(h) == ["one", "two"]
    put(tmp_path / "2.jsonl", row(3, "three"))
    h.append(jsonl.parse(read_lines(spark, str(tmp_path / "2.jsonl"))), 1)
    assert titles(h) == ["one", "three", "two"] and not (tmp_path / "h" / "events.new").exists()


def test_streams_of_one_history_do_not_overwrite_each_other(spark, tmp_path):
    from annalist.streaming.ingest import line_stream

    h = History(spark, str(tmp_path / "h"))
    for k in (0, 1):
        (tmp_path / f"in{k}").mkdir()
        put(tmp_path / f"in{k}" / "1.jsonl", row(k, f"of {k}"))
        h.follow(line_stream(spark, str(tmp_path / f"in{k}")), jsonl.parse, str(tmp_path / f"cp{k}"), feed=k).awaitTermination()
    assert titles(h) == ["of 0", "of 1"]
    assert counting.top(h.store(), "level", Scope(level="INFO")).collect()[0]["count"] == 2


def test_chained(spark):
    schema = "rid long, task string, label string, confidence double, src string, evidence string"
    one = spark.createDataFrame([(1, "kind", "fix", 1.0, "a", ""), (2, "area", "x", 0.5, "a", "")], schema)
    two = spark.createDataFrame([(1, "kind", "docs", 1.0, "b", ""), (1, "area", "y", 1.0, "b", "why"), (2, "area", "z", 1.0, "b", "")], schema)
    assert [tuple(r) for r in chained(one, two).orderBy("rid", "task").collect()] == [(1, "area", "y", 1.0, "b", "why"), (1, "kind", "fix", 1.0, "a", ""), (2, "area", "x", 0.5, "a", "")]


def test_told(spark):
    df = spark.range(12).selectExpr("id", "concat('x', id) AS name").orderBy("id")
    full = envelope.told(df, "ids", 10, total=12, first_ms=1_700_000_000_000, last_ms=1_700_000_001_000, index="ab12", warnings=["3 events have no time"])
    head, *rest = full.split("\n")
    assert head == "total=12 coverage=2023-11-14T22:13:20Z..2023-11-14T22:13:21Z truncated=true index=ab12 q=ids"
    assert rest[0] == "⚠ 3 events have no time" and rest[1] == "id\tname" and len(rest) == 12
    assert envelope.told(df, "ids", 20, total=12, depth="counts") == "total=12 coverage=- truncated=false q=ids"
    assert len(envelope.told(df, "ids", 20, total=12, depth="summary").split("\n")) == 7
    with pytest.raises(ValueError):
        envelope.told(df, "ids", 20, total=12, depth="deep")
