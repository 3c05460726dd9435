"""Operators on small histories whose answers are worked out by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.model import Store, as_events
from annalist.operators import code, counting, delivery, episodes, process, relations, reports, search
from annalist.operators.scope import Scope


def history(spark, rows, touches=(), links=(), **more):
    """Rows: (id, source, kind, at_ms, level, title, actor, attrs)."""
    full = [(k + 1, *r) for k, r in enumerate(rows)]
    events = spark.createDataFrame(full, "rid long, id string, source string, kind string, at_ms long, level string, title string, actor string, attrs map<string,string>")
    events = as_events(events.withColumn("template", F.regexp_replace("title", "[0-9]+", "<NUM>")))
    rid = {r[1]: r[0] for r in full}
    t = spark.createDataFrame([(rid[i], e, 1, a, d, {}) for i, e, a, d in touches], "rid long, entity string, weight long, added long, deleted long, attrs map<string,string>")
    entities = t.select("entity").distinct().select("entity", F.lit("file").alias("type"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("deleted"), F.lit(False).alias("excluded"))
    lk = spark.createDataFrame([(rid[i], r, x) for i, r, x in links], "rid long, rel string, target string")
    return Store.of(events, touches=t, links=lk, entities=entities, **more)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def logs(spark):
    events = [
        ("e1", "jsonl:a", "log", 1, "ERROR", "took 12 ms", "alice", {"env": "prod"}),
        ("e2", "jsonl:a", "log", 2, "ERROR", "took 340 ms", "alice", {"env": "prod"}),
        ("e3", "jsonl:b", "log", 3, "INFO", "cache miss", "bob", {"env": "staging"}),
        ("e4", "csv:c", "row", 4, "WARN", "took 5 ms", "bob", {}),
        ("e5", "csv:c", "log", 5, "INFO", "100% done", "alice", {"env": "prod"}),
        ("e6", "csv:c", "log", 0, "TRACE", "no time", None, {"env": ""}),
    ]
    touches = [("e1", "hot.rs", 1, 0), ("e2", "warm.rs", 1, 0), ("e3", "hot.rs", 1, 0), ("e4", "cold.rs", 1, 0), ("e5", "hot.rs", 1, 0)]
    return history(spark, events, touches, [("e1", "ticket", "T-1"), ("e3", "ticket", "T-1"), ("e4", "ticket", "T-2")])


def test_top(logs):
    assert rows(counting.top(logs, "level"))[:3] == [("ERROR", 2), ("INFO", 2), ("TRACE", 1)]
    assert rows(counting.top(logs, "entity")) == [("hot.rs", 3), ("cold.rs", 1), ("warm.rs", 1)]
    assert rows(counting.top(logs, "attr:env")) == [("prod", 3), ("staging", 1)]
    assert rows(counting.top(logs, "kind", Scope(since=4))) == [("log", 1), ("row", 1)]
    assert dict(rows(counting.top_with_rest(logs, "attr:env", limit=1))) == {"prod": 3, "(rest)": 1, "(no value)": 2}


@pytest.mark.parametrize(
    "scope, ids",
    [
        (Scope(source="jsonl"), "e1 e2 e3"),
        (Scope(source="jsonl:b"), "e3"),
        (Scope(source="jsonl,csv"), "e1 e2 e3 e4 e5 e6"),
        (Scope(kind="ro*"), "e4"),
        (Scope(level="error, warn"), "e1 e2 e4"),
        (Scope(grep="TOOK"), "e1 e2 e4"),
        (Scope(grep="0%"), "e5"),
        (Scope(attr=("env=p*",)), "e1 e2 e5"),
        (Scope(attr=("env:*",)), "e1 e2 e3 e5 e6"),
        (Scope(entity="hot.rs"), "e1 e3 e5"),
        (Scope(join="ticket"), "e1 e3 e4"),
        (Scope(join="ticket=T-1"), "e1 e3"),
        (Scope(join="ticket=T*"), "e1 e3 e4"),
        (Scope(join="ticket=@e3"), "e1 e3"),
        (Scope(since=2, until=4), "e2 e3"),
        (Scope(until=3), "e1 e2 e6"),
    ],
)
def test_scope(logs, scope, ids):
    assert sorted(r["id"] for r in scope.apply(logs).collect()) == ids.split()


def test_scope_refuses():
    for bad in (dict(since=5, until=5), dict(attr=("novalue",)), dict(attr=("a b:c",)), dict(join="a;b=c")):
        with pytest.raises(ValueError):
            Scope(**bad)


def test_patterns_stats_events_timeline(logs, spark):
    assert rows(counting.patterns(logs))[0] == ("took <NUM> ms", 3, "e4")
    assert [r[0] for r in rows(counting.events(logs, Scope(), descending=True, limit=2))] == ["e5", "e4"]
    assert rows(counting.timeline(logs, 2)) == [(0, "", 1), (2, "", 2), (4, "", 2)]
    before = history(spark, [("a", "s", "k", -1, "", "", None, {})])
    assert not rows(counting.timeline(before))
    numbers = [(str(k), "s", kind, k, "", "", None, {"ms": v}) for k, (kind, v) in enumerate([("Build", x) for x in ("10", "20", "30", "40", "300")] + [("Tests", "5"), ("Tests", "no-num"), ("Tests", "nan"), ("Tests", "1d")])]
    got = rows(counting.stats(history(spark, numbers), "ms", "kind"))
    assert got == [("Build", 5, 10, 30, 300, 300, 400), ("Tests", 1, 5, 5, 5, 5, 5)]


def test_correlate(spark):
    data = [("anchor", "git", "commit", 1000), ("git2", "git", "commit", 1005), ("j1", "jsonl", "ci.run", 995), ("j2", "jsonl", "log", 940), ("h1", "html", "ci.deploy", 1060), ("far", "html", "log", 1061), ("u", "html", "log", 0)]
    s = history(spark, [(i, src, k, t, "", "", None, {}) for i, src, k, t in data])
    assert [r[0] for r in rows(relations.correlate(s, "anchor", 60))] == ["j1", "j2", "h1"]
    assert [r[0] for r in rows(relations.correlate(s, "anchor", 60, "ci.*"))] == ["j1", "h1"]
    assert not rows(relations.correlate(s, "u", 60))


def test_gaps(spark):
    data = [("f1", "A", 10, "x"), ("f2", "A", 10, "y"), ("f3", "A", 0, "z"), ("f4", "A", 20, None), ("t1", "B", 15, "x"), ("t2", "B", 5, "y"), ("t3", "B", 9, "w")]
    s = history(spark, [(i, "s", k, t, "", "", None, {}) for i, k, t, _ in data], links=[(i, "K", v) for i, _, _, v in data if v])
    a, b = Scope(kind="A"), Scope(kind="B")
    assert relations.gaps(s, a, b, "K").first().asDict() == {"units": 3, "covered": 1, "missing": 1, "units_without_time": 1, "to_values": 3, "from_without_key": 1}
    assert relations.gaps(s, a, b, "K", any_order=True).first()["covered"] == 2
    assert [r["unit"] for r in relations.gap_sample(s, a, b, "K").collect()] == ["y"]


def test_trace(spark):
    data = [("aaaa1111", 1), ("bbbb2222", 2), ("c1", 3), ("c2", 4), ("d", 5), ("e", 6)]
    links = [("aaaa1111", "reverts", "bbbb2222"), ("c1", "ticket", "P-1"), ("c2", "ticket", "P-1"), ("d", "commit", "bbbb"), ("d", "ticket", "P-1")]
    s = history(spark, [(i, "s", "commit", t, "", "", None, {}) for i, t in data], links=links)
    assert [(r[0], r[1], r[2]) for r in rows(relations.trace(s, "aaaa1111"))] == [("bbbb2222", 1, "reverts"), ("d", 2, "commit"), ("c1", 3, "ticket:P-1"), ("c2", 3, "ticket:P-1")]
    assert [r[0] for r in rows(relations.trace(s, "bbbb2222", depth=1))] == ["aaaa1111", "d"]
    assert not rows(relations.trace(s, "e")) and not rows(relations.trace(s, "nothing"))


def _brute_episodes(anchors, gap):
    out = []
    for t, i in sorted(anchors):
        if out and t - out[-1][-1][0] <= gap:
            out[-1].append((t, i))
        else:
            out.append([(t, i)])
    return sorted((e[0][0], e[-1][0], len(e), e[0][1]) for e in out)


@pytest.mark.parametrize("gap", [5, 60])
def test_episodes_and_precursors_equal_brute_force(spark, gap):
    rng = random.Random(gap)
    data = [(f"i{k:03}", "s", "log", rng.randrange(1, 6000), rng.choice(["ERROR", "INFO", "WARN"]), rng.choice(["a 1", "b 2", "c"]), None, {"host": rng.choice("xyz")}) for k in range(400)]
    s = history(spark, data)
    got = rows(episodes.episodes(s, Scope(level="ERROR"), gap).select("start_ms", "end_ms", "anchors", "first_id"))
    want = _brute_episodes([(d[3], d[0]) for d in data if d[4] == "ERROR"], gap)
    assert sorted(got) == want
    by = episodes.episodes(s, Scope(level="ERROR"), gap, by_origin=True)
    assert by.count() == sum(len(_brute_episodes([(d[3], d[0]) for d in data if d[4] == "ERROR" and d[7]["host"] == h], gap)) for h in "xyz")
    window = 50
    met = episodes.precursors(s, Scope(level="ERROR"), gap, window)
    starts = [w[0] for w in want]
    origins = [{d[7]["host"] for d in data if d[4] == "ERROR" and w[0] <= d[3] <= w[1]} for w in want]
    n = sum(1 for t, o in zip(starts, origins) for d in data if t - window <= d[3] < t and d[7]["host"] not in o)  # all under a second before
    assert (met.agg(F.sum("count")).first()[0] or 0) == n


def test_cover(spark):
    at = spark.createDataFrame([("a", 0), ("a", 50), ("a", 300)], "k string, at long")
    assert rows(episodes.cover(at, ["k"], 100, 20, 350)) == [("a", (150 - 20) + 50)]


def test_code(spark):
    data = [(f"c{k}", "git", "commit", 10 * k, "", "", who, {}) for k, who in enumerate(["ann", "ann", "bob", None], 1)]
    s = history(spark, data, [("c1", "a/x.py", 5, 1), ("c1", "a/y.py", 1, 1), ("c2", "a/x.py", 2, -1), ("c2", "a/y.py", 0, 3), ("c3", "a/x.py", -1, 4), ("c4", "b/z.py", 9, 9)])
    assert rows(code.hotspots(s))[0] == ("a/x.py", 3, 1, 1.0)
    assert rows(code.churn(s))[0] == ("b/z.py", 9, 9) and ("a/x.py", 7, 5) in rows(code.churn(s))
    assert rows(code.coupling(s, "a/x.py")) == [("a/y.py", 2, 2 / 3)]
    assert rows(code.coupling_pairs(s)) == [("a/x.py", "a/y.py", 2)]
    assert [(r[0], r[1], r[3]) for r in rows(code.owners(s, "a/"))] == [("ann", 4, 1), ("bob", 1, 1)]
    assert rows(code.co_changes(s, "a/x.py")) == [("a/y.py", 2, "")]


def test_branches(spark):
    revs = spark.createDataFrame([("f", "ahead", "1", "ann", 100), ("f", "ahead", "2", "bob", 90), ("f", "behind", "3", "ann", 95), ("old", "behind", "4", "ann", 5)], "branch string, side string, sha string, author string, at_ms long")
    got = {r["branch"]: r.asDict() for r in code.branches(revs, stale=50).collect()}
    assert got["f"] == {"branch": "f", "ahead": 2, "behind": 1, "merged": False, "stale": False, "authors": 2, "bus_factor": 2}
    assert got["old"]["merged"] and got["old"]["stale"]


def test_process(spark):
    df = spark.createDataFrame([("s", t, ok) for t, ok in enumerate([0, 0, 0, 1, 0, 0, 0, 0])], "k string, at_ms long, ok int")
    assert [(r["length"], r["first_at"]) for r in process.streaks(df, ["k"], ["at_ms"], F.col("ok") == 0).orderBy("first_at").collect()] == [(3, 0), (4, 4)]
    costs = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 3.0), ("s", 3, 0.5)], "k string, at_ms long, c double")
    assert [r["delta"] for r in process.deltas(costs, ["k"], ["at_ms"], "c").orderBy("at_ms").collect()] == [1.0, 2.0, 0.5]
    asks = spark.createDataFrame([("j", 1, "q"), ("j", 1, "a"), ("j", 2, "q"), ("j", 9, "a"), ("j", 10, "q")], "k string, at_ms long, w string")
    got = process.following(asks, ["k"], F.col("w") == "q", F.col("w") == "a")
    assert [r["latency"] for r in got.orderBy("at_ms").collect()] == [0, 7, None]
    taken = process.carried(asks, ["k"], ["at_ms", "w"], F.when(F.col("w") == "a", F.col("at_ms")), F.col("w") == "q")
    assert [r["carried"] for r in taken.where("w = 'q'").orderBy("at_ms").collect()] == [1, None, 9]
    jobs = spark.createDataFrame([("a", True, 0, 1, 2, 2, True), ("b", False, 3, 1, 2, 2, True), ("c", False, 0, 1, 2, 2, False), ("d", False, None, 1, None, 1, False), ("e", False, None, 99, None, 100, False)], "job string, refused boolean, rc int, started_ms long, ended_ms long, last_ms long, has_output boolean")
    assert dict(rows(process.failures(jobs, stale=50))) == {"a": "refused", "b": "launch", "c": "no_output", "d": "never_ended"}


def test_sessions(spark):
    def event(t, kind, **attrs):
        return (f"n{t}", "nod", f"nod.{kind}", t, "", "", None, {"session": "s", "instance": "i", "run": "r", "seq": str(t)} | attrs)

    data = [
        event(0, "turn.start", turn="1"), event(5, "turn.step", turn="1", tokens="10", cost="1.0"), event(9, "turn.end", turn="1", duration_ms="7"),
        event(20, "turn.start", turn="2", task="T"), event(26, "turn.step", turn="2", tokens="5", cost="1.5"), *(event(30 + k, "tool.result", turn="2", tool="sh", ok="false") for k in range(3)),
        event(40, "permission.ask", wait_ms="4", by="user", decision="deny"),
    ]
    r = process.sessions(history(spark, data).events).first()
    assert (r["tokens"], r["cost"], r["agent_ms"], r["loops"], r["asked"], r["denied"], r["wait_ms"]) == (15, 1.5, 7 + 12, 1, 1, 1, 4)


def test_search(spark):
    titles = ["Connection refused by peer", "connexion refusée", "peer connection", "100%_literal"]
    s = history(spark, [(f"e{k}", "s", "log", k + 1, "", t, None, {}) for k, t in enumerate(titles)])
    assert [r[0] for r in rows(search.search(s, "connection REFUSED"))] == ["e0"]
    assert [r[0] for r in rows(search.search(s, "refusee"))] == ["e1"]
    assert [r[0] for r in rows(search.search(s, "%_LIT"))] == ["e3"]
    assert not rows(search.search(s, "absent"))


def test_similar(spark):
    base = 0x2BCD123456789ABC
    hashes = [base, base ^ 1, base ^ 0b111, base ^ 0b11111, base, -1]
    s = history(spark, [(f"e{k}", "s", "commit", 1, "", "", None, {}) for k in range(len(hashes))])
    table = spark.createDataFrame(list(enumerate(hashes, 1)), "rid long, h long")
    s = Store.of(s.events.drop("simhash").join(table.withColumnRenamed("h", "simhash"), "rid"))
    assert [(r["id"], r["distance"]) for r in search.similar(s, "e0").collect()] == [("e4", 0), ("e1", 1), ("e2", 3)]
    assert sorted(rows(search.similar_pairs(table))) == [(1, 2, 1), (1, 3, 3), (2, 3, 2), (3, 4, 2)]


def test_reports(logs):
    parts = {(r[0], r[1]) for r in rows(reports.log_report(logs))}
    assert ("level", "ERROR") in parts and ("entity", "hot.rs") in parts and ("episode", "e1") in parts
    assert ("rank", "hot.rs") in {(r[0], r[1]) for r in rows(reports.code_report(logs, "hot.rs"))}


def test_delivery(spark):
    rnd = random.Random(5)
    day = delivery.DAY
    commits = [(f"{rnd.getrandbits(160):040x}", "git", "commit", 1 + rnd.randrange(60) * day // 2, "", "", None, {}) for _ in range(120)]
    changes = [(c[0], f, rnd.randrange(-1, 9), rnd.randrange(5)) for c in commits for f in rnd.sample(["a", "b", "c", "d"], rnd.randrange(4))]
    groups = [(g, c[0][: rnd.choice([8, 12, 40])].upper() if k % 5 else c[0]) for k, c in enumerate(commits) for g in "xy" if rnd.random() < 0.3]
    groups += [("x", "abc"), ("x", "ffffffffffff"), ("y", ""), ("z", "eeeeeeeeeeee")]
    at = {c[0]: c[3] for c in commits}
    full = {sha: [c for c in at if c.startswith(sha.lower())] for _, sha in groups}
    want = {}
    for g in "xyz":
        shas = {sha for k, sha in groups if k == g and sha}
        ids = {full[s][0] for s in shas if len(s) > 3 and len(full[s]) == 1}
        weight = {(c, f): max(a, 0) + d for c, f, a, d in changes}
        mine = [x for x in weight if x[0] in ids]
        later = {(c, f) for c, f in weight if c not in ids and any(f == e and 0 < at[c] - at[i] <= 5 * day for i, e in mine)}
        files, redone = {f for _, f in mine}, {f for _, f in later}
        lost = sum(1 for s in shas if len(s) < 4 or len(full[s]) != 1)
        counts = (len(files), sum(weight[x] for x in mine), len(files & {"a"}), len(redone), sum(weight[x] for x in later), sum(at[i] + 5 * day > 25 * day for i in ids), len(redone) / max(len(files), 1))
        want[g] = (g, len(shas), lost, *(counts if ids else (None,) * 7))
    s = history(spark, commits, changes)
    table = spark.createDataFrame(groups, "key string, sha string")
    hot = spark.createDataFrame([("a",)], "entity string")
    out = rows(delivery.delivered(s, table, days=5, horizon=25 * day, hot=hot))
    assert {r[0]: r for r in out} == want
    assert want["x"][6] and want["y"][7]
    assert not rows(delivery.delivered(s, table.limit(0)))


def test_sha_that_two_commits_begin_with(spark):
    s = history(spark, [("abcd1" + "0" * 35, "git", "commit", 1, "", "", None, {}), ("abcd2" + "0" * 35, "git", "commit", 2, "", "", None, {})])
    shas = spark.createDataFrame([("abcd",), ("ABCD1",), ("abcd2", ), ("abcd%",)], "sha string")
    assert sorted(r["sha"] for r in delivery.resolved(shas, s.events).collect()) == ["ABCD1", "abcd2"]


def test_edits_left_out(spark):
    edits = spark.createDataFrame([("s", p) for p in ("/r/a", "/r/sub/b", "/r/sub/c", "/q/d", "/rest/e", "/r/a")] + [("t", "/q/d")], "key string, path string")
    roots = spark.createDataFrame([(None, "/r/"), ("s", "/r/sub"), ("t", "/q"), (None, "")], "key string, root string")
    committed = spark.createDataFrame([("s", "b"), ("t", "a")], "key string, entity string")
    assert sorted(rows(delivery.incomplete(edits, roots, committed))) == [("s", 3, 2, 2), ("t", 1, 1, 0)]


def test_merges(spark):
    groups = spark.createDataFrame([(k,) for k in "abcdefg"], "key string")
    branches = spark.createDataFrame([("a", "main"), ("b", "main"), ("b", "x"), ("c", "y"), ("d", "unknown"), ("f", "x")], "key string, branch string")
    states = spark.createDataFrame([("main", True), ("x", False), ("y", True)], "branch string, merged boolean")
    pulls = spark.createDataFrame([("f", True), ("f", False), ("e", False)], "key string, merged boolean")
    out = delivery.merges(groups, branches, states, pulls, base="main")
    assert sorted(rows(out)) == [("a", "merged", "branch"), ("b", "not_merged", "branch"), ("c", "merged", "branch"), ("d", "unknown", ""), ("e", "not_merged", "pr"), ("f", "merged", "pr"), ("g", "unknown", "")]
    assert rows(delivery.merge_rate(out)) == [(5, 3, 0.6)]
    assert rows(delivery.merge_rate(out.limit(0))) == [(0, 0, None)]


def test_ranked_groups(spark):
    groups = spark.createDataFrame([("a", None, 9, 0), ("b", 0.0, 1, 2), ("c", 2.0, 1, 4), ("d", 2.0, 5, 1), ("e", None, 9, 1)], "key string, cost double, tokens long, commits long")
    out = delivery.ranked(groups.withColumn("each", delivery.per_commit("cost")), 4)
    assert [(r["key"], r["each"]) for r in out.collect()] == [("d", 2.0), ("c", 0.5), ("b", 0.0), ("a", None)]
