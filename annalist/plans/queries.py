"""The registered queries of the event engine and the SQL that each must agree with.

Each pair is registered together: the function runs the operator, the SQL says what it must return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..ingest import Options, chained, ingest, labels_of, via
from ..model import Store
from ..operators import code, counting, delivery, episodes, process, relations, reports, search
from ..operators.scope import Scope
from ..sources import commands, jsonl, text
from . import rollups, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

DAY, HOUR, MINUTE = 86_400_000, 3_600_000, 60_000
#: 2024-01-05 and 2024-01-20, in the middle of the log events.
FROM, TO = 1_704_412_800_000, 1_705_708_800_000

_EV = """ev AS (
    SELECT event_id AS rid, 'ev:' || event_id AS id, 'events' AS source, event_type AS kind, epoch_us(ts) // 1000 AS at_ms,
        'user-' || user_id AS actor, event_type || ' value ' || CAST(floor(value) AS BIGINT) AS title, event_type || ' value <NUM>' AS template,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level, value,
        json_extract_string(props, '$.k') AS k, 'user/' || user_id AS entity, CAST(user_id AS VARCHAR) AS usr FROM events)"""
_TOUCH = """t AS (
    SELECT l_orderkey AS rid, p_brand || '/part/' || p_partkey AS entity, any_value(p_size) AS size, CAST(sum(l_quantity) AS BIGINT) AS added,
        CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS deleted
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand, p_partkey),
o AS (
    SELECT o_orderkey AS rid, 'order:' || o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS at_ms, 'customer-' || o_custkey AS actor, o_orderpriority AS level,
        lower(o_orderstatus) AS category, coalesce(n, 0) > 10 AS is_bulk
    FROM orders LEFT JOIN (SELECT rid AS r, count(*) AS n FROM t GROUP BY rid) ON r = o_orderkey)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


def _log(name: str, sql: str | None, run: Callable[[Store], DataFrame]) -> None:
    query(name, sql and f"WITH {_EV} {sql}")(lambda spark, sf_dir: run(tables.log_store(spark, sf_dir)))


def _orders(name: str, sql: str | None, run: Callable[[Store], DataFrame]) -> None:
    query(name, sql and f"WITH {_TOUCH} {sql}")(lambda spark, sf_dir: run(tables.order_store(spark, sf_dir)))


# --- counts --------------------------------------------------------------------------------------

_TOP = "SELECT {0} AS value, count(*) AS count FROM ev WHERE {1} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"
_log("top_level", _TOP.format("level", "true"), lambda s: counting.top(s, "level"))
_log("top_kind", _TOP.format("kind", "true"), lambda s: counting.top(s, "kind"))
_log("top_actor", _TOP.format("actor", "true"), lambda s: counting.top(s, "actor"))
_log("top_entity", _TOP.format("entity", "true"), lambda s: counting.top(s, "entity"))
_log("top_attr", _TOP.format("k", "k <> ''"), lambda s: counting.top(s, "attr:k"))
_log("top_filtered", _TOP.format("entity", f"level IN ('ERROR', 'WARN') AND at_ms >= {FROM} AND at_ms < {TO}"), lambda s: counting.top(s, "entity", Scope(since=FROM, until=TO, level="error, warn")))
_log("top_with_rest", f"""SELECT * FROM ({_TOP.format('entity', 'true')}) UNION ALL
    SELECT '(rest)', (SELECT count(*) FROM ev) - sum(count) FROM ({_TOP.format('entity', 'true')}) HAVING (SELECT count(*) FROM ev) > sum(count)""", lambda s: counting.top_with_rest(s, "entity"))
_log("top_by_level", """, c AS (SELECT level, entity AS value, count(*) AS count FROM ev GROUP BY 1, 2)
    SELECT level, value, count FROM c QUALIFY row_number() OVER (PARTITION BY level ORDER BY count DESC, value) <= 10""", lambda s: counting.top_by_level(s, "entity"))
_log("scope_grep", _TOP.format("kind", "lower(title) LIKE '%or value 1%'"), lambda s: counting.top(s, "kind", Scope(grep="OR value 1")))
_log("scope_kind_prefix", _TOP.format("kind", "kind LIKE 'pur%' OR kind = 'view'"), lambda s: counting.top(s, "kind", Scope(kind="pur*,view")))
_log("scope_entity", _TOP.format("kind", "entity IN ('user/1', 'user/2')"), lambda s: counting.top(s, "kind", Scope(entity="user/1,user/2")))
_log("scope_attr_prefix", _TOP.format("level", "k LIKE '1%'"), lambda s: counting.top(s, "level", Scope(attr=("k:1*",))))
_log("scope_join_value", _TOP.format("kind", "usr = '7'"), lambda s: counting.top(s, "kind", Scope(join="user=7")))
_log("join_prefix", _TOP.format("kind", "usr LIKE '1%'"), lambda s: counting.top(s, "kind", Scope(join="user=1*")))
_log("join_has_key", _TOP.format("kind", "k IS NOT NULL"), lambda s: counting.top(s, "kind", Scope(join="k")))
_log("join_shared_value", _TOP.format("kind", "usr IN (SELECT usr FROM ev WHERE id = 'ev:5')"), lambda s: counting.top(s, "kind", Scope(join="user=@ev:5")))
_TIME = "SELECT at_ms // {0} * {0} AS bucket, {1} AS key, count(*) AS count FROM ev WHERE at_ms > 0 GROUP BY 1, 2"
_log("timeline_1h", _TIME.format(HOUR, "''") + " ORDER BY 1, 2 LIMIT 500", lambda s: counting.timeline(s))
_log("timeline_1d_by_level", _TIME.format(DAY, "level"), lambda s: counting.timeline(s, DAY, "level", limit=None))
_log("timeline_1h_by_kind", _TIME.format(HOUR, "kind"), lambda s: counting.timeline(s, HOUR, "kind", limit=None))
_log("peaks", f"SELECT at_ms // 600000 * 600000 AS bucket, count(*) AS count FROM ev WHERE level = 'ERROR' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", lambda s: counting.peaks(s, scope=Scope(level="ERROR"), limit=5))
_log("patterns", "SELECT template, count(*) AS count, arg_max(id, rid) AS example_id FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", lambda s: counting.patterns(s))
_STATS = """SELECT {0} AS "group", count(*) AS n, min(value) AS min, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max, round(sum(value), 4) AS sum FROM ev {1} GROUP BY 1"""
_rounded = lambda df: df.withColumn("sum", F.round("sum", 4))  # noqa: E731  sums depend on the order of the addends
_log("stats_value_by_kind", _STATS.format("kind", ""), lambda s: _rounded(counting.stats(s, "value", "kind", limit=None)))
_log("stats_by_entity", _STATS.format("entity", "WHERE level = 'ERROR'"), lambda s: _rounded(counting.stats(s, "value", "entity", Scope(level="ERROR"), limit=None)))
_log("stats_by_attr", _STATS.format("k", ""), lambda s: _rounded(counting.stats(s, "value", "attr:k", limit=None)))
_EVENT = "SELECT id, source, kind, at_ms, level, title FROM ev WHERE {0} ORDER BY at_ms {1}, id {1} LIMIT 100"
_log("events_asc", _EVENT.format("level = 'ERROR'", "ASC"), lambda s: counting.events(s, Scope(level="ERROR")))
_log("events_desc", _EVENT.format(f"at_ms < {TO}", "DESC"), lambda s: counting.events(s, Scope(until=TO), descending=True))
_log("count_events", f"SELECT count(*) AS total FROM ev WHERE kind = 'view' AND at_ms >= {FROM}", lambda s: counting.count_events(s, Scope(kind="view", since=FROM)))
_log("coverage", "SELECT source, count(*) AS events, 0 AS untimed, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM ev GROUP BY 1", lambda s: counting.coverage(s))
_log("sources_inventory", """, f AS (SELECT source, 'level' AS what, level AS value FROM ev UNION ALL SELECT source, 'level_inf', level FROM ev UNION ALL SELECT source, 'kind', kind FROM ev UNION ALL SELECT source, 'entity', entity FROM ev),
    c AS (SELECT source, what, value, count(*) AS count FROM f GROUP BY ALL)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source, what ORDER BY count DESC, value) <= CASE what WHEN 'kind' THEN 5 WHEN 'entity' THEN 15 ELSE 10 END""", lambda s: counting.sources(s))
_log("check_attr_keys", "SELECT 'value' AS key, count(*) AS events FROM ev UNION ALL SELECT 'k', count(*) FROM ev", lambda s: counting.attr_keys(s))
_log("check_unknown_levels", "SELECT x AS level FROM (VALUES ('FATAL'), ('ERROR')) v(x) WHERE x NOT IN (SELECT level FROM ev)", lambda s: counting.unknown_levels(s, ["fatal", "error"]))
_log("check_relation_keys", "SELECT 'user' AS key, count(DISTINCT rid) AS events, count(DISTINCT usr) AS values FROM ev UNION ALL SELECT 'k', count(DISTINCT rid), count(DISTINCT k) FROM ev WHERE k IS NOT NULL", lambda s: counting.relation_keys(s))
_log("check_event_keys", "SELECT 'user' AS k, usr AS v FROM ev WHERE id = 'ev:5' UNION ALL SELECT 'k', k FROM ev WHERE id = 'ev:5'", lambda s: counting.event_relation_keys(s, "ev:5"))
_log("check_untimed", "SELECT source, count(*) AS untimed FROM ev WHERE at_ms <= 0 GROUP BY 1", lambda s: counting.untimed_events(s))
_log("check_sources_of_kind", "SELECT source, count(*) AS events FROM ev WHERE kind = 'error' GROUP BY 1", lambda s: counting.sources_of_kind(s, "error"))

# --- relations -----------------------------------------------------------------------------------


def _both(spark: SparkSession, sf_dir: str) -> Store:
    """Log events, the errors as a source of their own."""
    s = tables.log_store(spark, sf_dir)
    events = s.events.withColumn("source", F.when(F.col("kind") == "error", "errors").otherwise(F.col("source")))
    return Store.of(events, touches=s.touches, links=s.links, entities=s.entities)


_NEAR = f"""WITH {_EV}, e AS (SELECT * REPLACE (CASE kind WHEN 'error' THEN 'errors' ELSE source END AS source) FROM ev), a AS (SELECT at_ms AS t0, source AS s0 FROM e WHERE id = 'ev:50')
    SELECT id, source, kind, at_ms, level, title, at_ms - t0 AS delta_ms FROM e, a WHERE abs(at_ms - t0) <= {{0}} AND source <> s0 {{1}} ORDER BY abs(at_ms - t0), at_ms, id LIMIT 25"""
query("correlate_window", _NEAR.format(12 * HOUR, ""))(lambda spark, d: relations.correlate(_both(spark, d), "ev:50", 12 * HOUR))
query("correlate_kinds", _NEAR.format(12 * HOUR, "AND (kind LIKE 'err%' OR kind = 'view')"))(lambda spark, d: relations.correlate(_both(spark, d), "ev:50", 12 * HOUR, "err*,view"))
_SHARED = "usr IN (SELECT usr FROM ev WHERE id = 'ev:50') AND id <> 'ev:50'"
_log("correlate_via", f"SELECT id, source, kind, at_ms, level, title FROM ev WHERE {_SHARED} ORDER BY at_ms, id LIMIT 25", lambda s: relations.correlate_via(s, "ev:50", "user"))
_log("correlate_via_totals", f"SELECT source, NULL AS kind, NULL AS level, count(*) AS count FROM ev WHERE {_SHARED} GROUP BY source UNION ALL SELECT NULL, kind, level, count(*) FROM ev WHERE {_SHARED} GROUP BY kind, level", lambda s: relations.via_totals(s, "ev:50", "user"))
_GAP = """, f AS (SELECT {0} AS unit, usr AS v, rid, at_ms FROM ev WHERE kind = 'signup'), t AS (SELECT usr AS v, at_ms FROM ev WHERE kind = 'purchase' AND value > 90),
    fu AS (SELECT unit, min(at_ms) AS since FROM f GROUP BY 1), tl AS (SELECT v, max(at_ms) AS last FROM t GROUP BY 1),
    c AS (SELECT DISTINCT f.unit FROM f JOIN tl USING (v) JOIN fu ON f.unit = fu.unit WHERE {1})"""
_COUNTS = _GAP + """ SELECT (SELECT count(DISTINCT unit) FROM f) AS units, (SELECT count(*) FROM c) AS covered, (SELECT count(DISTINCT unit) FROM f) - (SELECT count(*) FROM c) AS missing,
    0 AS units_without_time, (SELECT count(DISTINCT v) FROM t) AS to_values, 0 AS from_without_key"""
_DEAR = lambda: (Scope(kind="signup"), Scope(kind="purchase", attr=("dear=yes",)))


def _dear(s: Store) -> Store:
    marked = s.events.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("dear"), F.when(F.expr("CAST(attrs['value'] AS DOUBLE) > 90"), "yes").otherwise("no"))))
    return Store.of(marked, touches=s.touches, links=s.links, entities=s.entities)


_log("gaps_ordered", _COUNTS.format("usr", "last >= since"), lambda s: relations.gaps(_dear(s), *_DEAR(), "user"))
_log("gaps_any_order", _COUNTS.format("usr", "true"), lambda s: relations.gaps(_dear(s), *_DEAR(), "user", any_order=True))
_log("gaps_by_unit", _COUNTS.format("k", "last >= since"), lambda s: relations.gaps(_dear(s), *_DEAR(), "user", by="k"))
_log("gaps_sample", _GAP.format("usr", "last >= since") + " SELECT unit, count(DISTINCT rid) AS events, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM f WHERE unit NOT IN (SELECT unit FROM c) GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 25", lambda s: relations.gap_sample(_dear(s), *_DEAR(), "user"))
query("gaps_chat", """
    WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS unit, min((conv_id * 1000 + turn + 1) * 1000) AS since, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1),
    t AS (SELECT CAST(conv_id AS VARCHAR) AS unit, max((conv_id * 1000 + turn + 1) * 1000) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT count(*) AS units, count(*) FILTER (last >= since) AS covered, count(*) FILTER (last IS NULL OR last < since) AS missing, 0 AS units_without_time,
        (SELECT count(*) FROM t) AS to_values, 0 AS from_without_key FROM f LEFT JOIN t USING (unit)""")(
    lambda spark, d: relations.gaps(tables.chat_store(spark, d), Scope(kind="user"), Scope(kind="assistant"), "conv"))
query("trace_bfs", f"""WITH RECURSIVE {_TOUCH}, l AS (SELECT o_orderkey AS rid, 'cust:' || o_custkey AS rel FROM orders),
    w AS (SELECT DISTINCT b.rid, b.rel FROM l a JOIN l b USING (rel) WHERE a.rid = 1 AND b.rid <> 1)
    SELECT id, 1 AS depth, rel, at_ms FROM w JOIN o USING (rid) ORDER BY at_ms, id LIMIT 20""")(
    lambda spark, d: relations.trace(_customers(tables.order_store(spark, d)), "order:1", limit=20))


def _customers(s: Store) -> Store:
    return Store.of(s.events, links=s.links.where("rel = 'cust'"))


# --- episodes ------------------------------------------------------------------------------------

TEN = 600_000
_EP = """, s AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER w <= {1} THEN 0 ELSE 1 END AS fresh FROM (SELECT *, {0} AS grp FROM ev WHERE level = 'ERROR') WINDOW w AS (PARTITION BY grp ORDER BY at_ms, id)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) AS no FROM s),
    ep AS (SELECT grp, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(*) AS anchors, arg_min(id, (at_ms, id)) AS first_id, list(DISTINCT entity) AS origins FROM n GROUP BY grp, no)"""
_shown = ["grp", "start_ms", "end_ms", "anchors", "first_id", "n_origins"]
_EPISODES = _EP + " SELECT grp, start_ms, end_ms, anchors, first_id, len(origins) AS n_origins FROM ep"
_ERR = Scope(level="ERROR")
_slim = lambda df: df.withColumn("n_origins", F.size("origins")).select(*_shown)
_log("episodes", _EPISODES.format("''", TEN), lambda s: _slim(episodes.episodes(s, _ERR, TEN)))
_log("episodes_by_origin", _EPISODES.format("entity", DAY), lambda s: _slim(episodes.episodes(s, _ERR, DAY, by_origin=True)))
_log("episodes_by_key", _EPISODES.format("k", DAY), lambda s: _slim(episodes.episodes(s, _ERR, DAY, key="k")))
_PRE = _EP + """, m AS (SELECT ep.grp, start_ms, ep.first_id, ev.level, ev.template, ev.entity AS origin, ev.id, ev.at_ms FROM ev JOIN ep ON {2} ev.at_ms >= start_ms - {1} AND ev.at_ms < start_ms
        AND NOT (start_ms - ev.at_ms < 1000 AND list_contains(origins, ev.entity)))"""
_PRE_ROWS = _PRE + " SELECT grp, start_ms, first_id, level, template, origin, count(*) AS count, max(at_ms) AS last_ms, arg_max(id, (at_ms, id)) AS example_id FROM m GROUP BY ALL"
_log("precede_precursors", _PRE_ROWS.format("''", TEN, ""), lambda s: episodes.precursors(s, _ERR, TEN, TEN))
_log("precede_by_key", _PRE_ROWS.format("k", TEN, "ev.k = ep.grp AND"), lambda s: episodes.precursors(s, _ERR, TEN, TEN, key="k"))
_W = TEN + MINUTE
_log("precede_lift", _PRE.format("''", TEN, "") + f""", c AS (SELECT level, template, count(*) AS episodes FROM (SELECT DISTINCT start_ms, first_id, level, template FROM m) GROUP BY 1, 2 HAVING count(*) >= 2 OR (SELECT count(*) FROM ep) = 1),
    span AS (SELECT min(at_ms) AS lo, max(at_ms) + 1 AS hi FROM ev), b AS (SELECT DISTINCT template, at_ms // 60000 * 60000 AS m0 FROM ev), a AS (SELECT DISTINCT at_ms // 60000 * 60000 AS m0 FROM ev),
    bt AS (SELECT template, sum(greatest(0, least(m0 + {_W}, coalesce(nxt, hi), hi) - greatest(m0, lo))) AS covered FROM (SELECT *, lead(m0) OVER (PARTITION BY template ORDER BY m0) AS nxt FROM b), span GROUP BY 1),
    av AS (SELECT sum(greatest(0, least(m0 + {_W}, coalesce(nxt, hi), hi) - greatest(m0, lo))) AS active FROM (SELECT *, lead(m0) OVER (ORDER BY m0) AS nxt FROM a), span),
    n2 AS (SELECT count(*) AS active_episodes FROM ep WHERE EXISTS (SELECT 1 FROM a WHERE start_ms >= m0 AND start_ms < m0 + {_W}))
    SELECT level, template, episodes, active_episodes, round(least(1.0, covered / active), 9) AS base_rate, round(least(1.0, covered / active) * active_episodes, 6) AS expected,
        round(episodes / active_episodes / least(1.0, covered / active), 6) AS lift FROM c JOIN bt USING (template), av, n2""",
    lambda s: episodes.common_precursors(s, _ERR, TEN, TEN, limit=None).select("level", "template", "episodes", "active_episodes", F.round("base_rate", 9).alias("base_rate"), F.round("expected", 6).alias("expected"), F.round("lift", 6).alias("lift")))

# --- what changes --------------------------------------------------------------------------------

_orders("hotspots", """, r AS (SELECT entity, size, count(*) AS changes, count(*) * greatest(size, 1) AS raw FROM t GROUP BY 1, 2 ORDER BY 4 DESC, 1 LIMIT 25)
    SELECT entity, changes, size, raw / max(raw) OVER () AS score FROM r""", lambda s: code.hotspots(s))
_orders("churn", "SELECT entity, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM t GROUP BY 1 ORDER BY sum(added) + sum(deleted) DESC, 1 LIMIT 25", lambda s: code.churn(s))
_SMALL = ", x AS (SELECT t.rid, entity FROM t JOIN o USING (rid) WHERE NOT is_bulk)"
_orders("coupling_pairs", _SMALL + " SELECT a.entity AS a, b.entity AS b, count(*) AS support FROM x a JOIN x b ON a.rid = b.rid AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2", lambda s: code.coupling_pairs(s))
_MOST = "(SELECT p_brand || '/part/' || p_partkey FROM part WHERE p_partkey = 7)"
query("coupling", f"WITH {_TOUCH} {_SMALL}, m AS (SELECT rid FROM x WHERE entity = {_MOST}) SELECT entity, count(*) AS support, count(*) / (SELECT count(*) FROM m) AS confidence FROM x WHERE rid IN (SELECT rid FROM m) AND entity <> {_MOST} GROUP BY 1 HAVING count(*) >= 1 ORDER BY 2 DESC, 1 LIMIT 25")(
    lambda spark, d: code.coupling(tables.order_store(spark, d), _part(spark, d), least=1))


def _part(spark: SparkSession, sf_dir: str) -> str:
    row = tables.read(spark, sf_dir, "part").where("p_partkey = 7").first()
    return f"{row['p_brand']}/part/7"


_orders("owners_bus_factor", """, c AS (SELECT actor, count(*) AS changes FROM t JOIN o USING (rid) WHERE starts_with(entity, 'Brand#2') GROUP BY 1),
    r AS (SELECT *, sum(changes) OVER () AS total, coalesce(sum(changes) OVER (ORDER BY changes DESC, actor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT actor, changes, changes / total AS share, count(*) FILTER (before < (total + 1) // 2) OVER () AS bus_factor FROM r""", lambda s: code.owners(s, "Brand#2"))
_FIX = ", f AS (SELECT o.* FROM o WHERE NOT is_bulk AND rid IN (SELECT rid FROM t WHERE deleted > 0))"
_orders("bugs_areas", _FIX + f""", r AS (SELECT f.rid, at_ms >= (SELECT max(at_ms) FROM o) - {code.RECENT} AS late, split_part(entity, '/', 1) || '/' || split_part(entity, '/', 2) AS dir FROM f JOIN t USING (rid))
    SELECT dir, count(DISTINCT rid) AS fixes, count(DISTINCT CASE WHEN late THEN rid END) AS recent FROM r GROUP BY 1 ORDER BY count(DISTINCT rid) + count(DISTINCT CASE WHEN late THEN rid END) DESC, 1 LIMIT 15""", lambda s: code.bug_areas(s))
_orders("bugs_categories", _FIX + """, h AS (SELECT category, entity, count(*) AS n FROM f JOIN t USING (rid) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, entity) <= 3),
    e AS (SELECT category, id, at_ms FROM f QUALIFY row_number() OVER (PARTITION BY category ORDER BY at_ms DESC, id) <= 2)
    SELECT category, count(*) AS fixes, (SELECT string_agg(entity, ',' ORDER BY n DESC, entity) FROM h WHERE h.category = f.category) AS files, (SELECT string_agg(id, ',' ORDER BY at_ms DESC, id) FROM e WHERE e.category = f.category) AS examples
    FROM f GROUP BY category""", lambda s: code.bug_categories(s))
_orders("tickets", "SELECT id, at_ms, actor, 'order status ' || upper(category) AS title FROM o WHERE rid IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)", lambda s: code.ticket(s, "3", "supp"))
_orders("ticket_files", "SELECT DISTINCT entity FROM t WHERE rid IN (SELECT o_orderkey FROM orders WHERE o_custkey = 5) ORDER BY 1 LIMIT 50", lambda s: code.ticket_files(s, "5", "cust"))


@query("explain", f"""WITH {_TOUCH} SELECT 'order:' || (o_orderkey * 2) AS sha, 'a' || o_custkey AS author, o_orderkey AS author_ms, 1 AS lines, CASE WHEN o.rid IS NOT NULL THEN 'order status ' || upper(category) END AS title,
    CASE WHEN o.rid IS NULL THEN '-' WHEN o.rid IN (SELECT rid FROM t WHERE deleted > 0) THEN 'yes' ELSE 'no' END AS fix
    FROM orders LEFT JOIN o ON o.rid = o_orderkey * 2 ORDER BY o_orderkey DESC LIMIT 15""")
def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    blame = tables.read(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), (F.col("o_orderkey") * 2).cast("string")).alias("sha"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("author"), F.col("o_orderkey").alias("author_ms"), F.lit(1).alias("lines"))
    return code.explain(tables.order_store(spark, sf_dir), blame, "")


_P = "'part/' || l_partkey"
query("co_changes", f"""WITH x AS (SELECT DISTINCT l_orderkey AS rid, {_P} AS entity FROM lineitem), m AS (SELECT rid FROM x WHERE entity = 'part/7')
    SELECT entity, count(*) AS commits, '' AS symbols FROM x WHERE rid IN (SELECT rid FROM m) AND entity <> 'part/7' GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 8""")(lambda spark, d: code.co_changes(_parts(spark, d), "part/7"))


def _parts(spark: SparkSession, sf_dir: str) -> Store:
    s = tables.order_store(spark, sf_dir)
    return Store.of(s.events, touches=s.touches.withColumn("entity", F.regexp_replace("entity", "^.*?/", "")))



def _forge(spark: SparkSession, sf_dir: str) -> Store:
    """Orders as issues of a forge, urgent ones as pull requests; customers' first orders as tags."""
    s, o = tables.order_store(spark, sf_dir), tables.read(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "pr").otherwise("issue")
    issues = o.select(F.col("o_orderkey").alias("number"), kind.alias("kind"), F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("state"), F.lit("").alias("labels"), (F.col("o_orderstatus") == "F").alias("merged"), tables.ms("o_orderdate").alias("closed_at"), F.lit(False).alias("is_bug"))
    tags = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(F.lit("git").alias("source"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("name"), F.col("k").alias("at_ms"), F.lit("").alias("ref"), F.lit("tag").alias("kind"))
    return Store.of(s.events, issues=issues, markers=tags)


query("prs", "SELECT o_orderkey AS number, 'Order ' || o_orderpriority AS title, o_orderstatus AS state, o_orderstatus = 'F' AS merged, epoch_us(o_orderdate) // 1000 AS closed_at FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY 1 DESC LIMIT 30")(lambda spark, d: code.prs(_forge(spark, d)))
query("ticket_prs", "SELECT o_orderkey AS number, 'Order ' || o_orderpriority AS title, o_orderstatus AS state, o_orderstatus = 'F' AS merged FROM orders WHERE o_orderpriority LIKE '1%' AND lower('Order ' || o_orderpriority) LIKE '%urgent%'")(lambda spark, d: code.ticket_prs(_forge(spark, d), "URGENT"))
query("phases", "SELECT 'v' || o_custkey AS name, min(o_orderkey) AS at_ms, '' AS ref FROM orders GROUP BY o_custkey")(lambda spark, d: code.phases(_forge(spark, d)))

# --- processes -----------------------------------------------------------------------------------

_log("streaks", """, s AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY actor ORDER BY at_ms, rid ROWS UNBOUNDED PRECEDING) AS run FROM ev)
    SELECT actor, count(*) AS length, min(at_ms) AS first_at, max(at_ms) AS last_at FROM s WHERE kind = 'error' GROUP BY actor, run HAVING count(*) >= 3""",
    lambda s: process.streaks(s.events, ["actor"], ["at_ms", "rid"], F.col("kind") == "error").select("actor", "length", "first_at", "last_at"))
_log("cost_deltas", """, d AS (SELECT actor, rid, value, lag(value) OVER (PARTITION BY actor ORDER BY at_ms, rid) AS p FROM ev)
    SELECT rid, value, CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END AS delta FROM d""",
    lambda s: process.deltas(s.events.withColumn("value", F.expr("CAST(attrs['value'] AS DOUBLE)")), ["actor"], ["at_ms", "rid"], "value").select("rid", "value", "delta"))
_ASK = "SELECT a.rid, min(b.at_ms) - any_value(a.at_ms) AS latency FROM ev a LEFT JOIN ev b ON a.actor = b.actor AND b.kind = 'purchase' AND b.at_ms >= a.at_ms WHERE a.kind = 'view' GROUP BY a.rid"
_asked = lambda s: process.following(s.events, ["actor"], F.col("kind") == "view", F.col("kind") == "purchase")
_log("latency_asof", _ASK, lambda s: _asked(s).select("rid", "latency"))
_log("latency_summary", f", l AS ({_ASK}) SELECT 'view' AS kind, count(*) AS n, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.9) AS p90, max(latency) AS max, count(*) FILTER (latency > 1800000) AS slow FROM l WHERE latency IS NOT NULL", lambda s: process.latency_summary(_asked(s), ["kind"]))
_log("carry_forward", """, n AS (SELECT *, coalesce(sum((kind = 'purchase')::INT) OVER (PARTITION BY actor ORDER BY at_ms, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ev)
    SELECT rid, carried FROM (SELECT rid, kind, last_value(CASE WHEN kind = 'click' THEN id END IGNORE NULLS) OVER (PARTITION BY actor, no ORDER BY at_ms, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM n) WHERE kind = 'purchase'""",
    lambda s: process.carried(s.events, ["actor"], ["at_ms", "rid"], F.when(F.col("kind") == "click", F.col("id")), F.col("kind") == "purchase").where("kind = 'purchase'").select("rid", "carried"))
_orders("rework_30d", f", c AS (SELECT rid, actor, entity, at_ms FROM t JOIN o USING (rid)) SELECT a.actor AS \"group\", a.entity, count(*) AS pairs FROM c a JOIN c b ON a.entity = b.entity AND b.at_ms > a.at_ms AND b.at_ms <= a.at_ms + {30 * DAY} AND a.actor <> b.actor GROUP BY 1, 2",
    lambda s: process.rework(s.touches.join(s.events.select("rid", F.col("actor").alias("group"), "at_ms"), "rid").select("rid", "group", "entity", "at_ms"), 30 * DAY))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job"), F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("profile"))


query("jobs_spend", "SELECT o_orderpriority AS key, count(*) AS jobs, round(sum(o_totalprice), 2) AS cost, round(sum(o_totalprice) / count(*), 4) AS cost_per_job FROM orders GROUP BY 1")(
    lambda spark, d: process.spend(_jobs(spark, d), "profile").select("key", "jobs", F.round("cost", 2).alias("cost"), F.round("cost_per_job", 4).alias("cost_per_job")))
query("jobs_audit", """SELECT state, count(*) AS jobs FROM (SELECT CASE WHEN a.job IS NULL THEN 'not_audited' WHEN o_orderkey IS NULL THEN 'only_audited' WHEN abs(o_totalprice - paid) <= 0.005 THEN 'match' ELSE 'differs' END AS state
    FROM orders FULL JOIN (SELECT o_orderkey + 10 AS job, o_totalprice AS paid FROM orders) a ON a.job = o_orderkey) GROUP BY 1""")(
    lambda spark, d: process.audit(_jobs(spark, d), _jobs(spark, d).select((F.col("job") + 10).alias("job"), F.col("cost").alias("cost_usd"))).groupBy("state").agg(F.count("*").alias("jobs")))

# --- texts ---------------------------------------------------------------------------------------

_DOC = "d AS (SELECT doc_id AS rid, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents)"
_WORDS = r"list_filter(regexp_split_to_array(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXTS = r"x AS (SELECT doc_id AS rid, 'doc:' || doc_id AS id, coalesce(source, '') AS source, split_part(coalesce(text, ''), chr(10), 1) AS title, CASE WHEN instr(coalesce(text, ''), chr(10)) > 0 THEN regexp_replace(text, chr(10), ' ') ELSE coalesce(text, '') || ' ' END AS both_ FROM documents)"
query("search_fallback", f"WITH {_TEXTS} SELECT id, source, 'doc' AS kind, 0 AS at_ms, title, 0.0::DOUBLE AS score FROM x WHERE {_AZ.format('both_')} LIKE '%e of th%' ORDER BY id LIMIT 25")(
    lambda spark, d: search.search(tables.text_store(spark, d), "e oF th"))
_IDF = "greatest(ln((docs - d{0} + 0.5) / (d{0} + 0.5)), 1e-6) * t{0} * 2.2 / (t{0} + 1.2 * (0.25 + 0.75 * n / mean))"
query("search_phrase", f"""WITH {_TEXTS}, w AS (SELECT *, {_WORDS.format('both_')} AS t FROM x),
    c AS (SELECT *, len(t) AS n, len(list_filter(t, lambda x: x = 'and')) AS t0, len(list_filter(t, lambda x: x = 'the')) AS t1 FROM w),
    g AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)
    SELECT id, source, 'doc' AS kind, 0 AS at_ms, title, round({_IDF.format(0)} + {_IDF.format(1)}, 6) AS score FROM c, g
    WHERE ' ' || array_to_string(t, ' ') || ' ' LIKE '% and the %' ORDER BY {_IDF.format(0)} + {_IDF.format(1)} DESC, rid LIMIT 25""")(
    lambda spark, d: search.search(tables.text_store(spark, d), "And, the").withColumn("score", F.round("score", 6)))
query("search_bm25", r"""WITH w AS (SELECT doc_id AS rid, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
    c AS (SELECT rid, len(t) AS n, len(list_filter(t, lambda x: x = 'with')) AS a, len(list_filter(t, lambda x: x = 'que')) AS b FROM w),
    g AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
    SELECT rid, round(greatest(ln((docs - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(ln((docs - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, g WHERE a > 0 AND b > 0""")(
    lambda spark, d: search.bm25(_doc_texts(spark, d), ["with", "que"], None).select("rid", F.round("score", 6).alias("score")))


def _doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), "text")


query("search_postings", ORACLE["search_bm25"])(
    lambda spark, d: search.ranked(search.postings(_doc_texts(spark, d)), search.lengths(_doc_texts(spark, d)), ["que", "with"], None).select("rid", F.round("score", 6).alias("score")))
query("infer_level", r"""WITH l AS (SELECT doc_id, substr((CASE doc_id % 3 WHEN 0 THEN 'ERROR: ' WHEN 1 THEN 'x WARN ' ELSE '' END) || split_part(coalesce(text, ''), chr(10), 1), 1, 200) AS line FROM documents),
    f AS (SELECT doc_id, regexp_extract(line, '(^|[^A-Za-z0-9])(PANIC|FATAL|CRITICAL|CRIT|ERROR|WARNING|WARN)([:\] \t|>]|$)', 2) AS word, upper(regexp_extract(lower(line), '(level=|"level": ?")(panic|fatal|critical|crit|error|warning|warn)([^a-z]|$)', 2)) AS pair FROM l)
    SELECT doc_id, CASE CASE WHEN word <> '' THEN word ELSE pair END WHEN 'PANIC' THEN 'FATAL' WHEN 'FATAL' THEN 'FATAL' WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'CRIT' THEN 'CRITICAL' WHEN 'ERROR' THEN 'ERROR' WHEN 'WARNING' THEN 'WARNING' WHEN 'WARN' THEN 'WARNING' ELSE '' END AS level_inf FROM f""")(
    lambda spark, d: tables.read(spark, d, "documents").select("doc_id", T.inferred_level(F.concat(F.when(F.col("doc_id") % 3 == 0, "ERROR: ").when(F.col("doc_id") % 3 == 1, "x WARN ").otherwise(""), F.coalesce("text", F.lit("")))).alias("level_inf")))
query("infer_level_pairs", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN '' ELSE 'FATAL' END AS level_inf FROM events""")(
    lambda spark, d: tables.read(spark, d, "events").select("event_id", T.inferred_level(F.concat_ws(" ", "event_type", F.element_at(F.array(*map(F.lit, ("LEVEL=Error x", '"level": "warn"', "level=crit", "level=errors", "level=info PANIC: x"))), (F.col("event_id") % 5 + 1).cast("int")))).alias("level_inf")))
query("tickets_extract", r"""SELECT conv_id, turn, regexp_extract_all('see ABC-' || conv_id || ' and #' || turn || ' ABC-' || conv_id, '[A-Z]+-[0-9]+|#[0-9]+')[1:2] AS found FROM conversations""".replace(" AS found", "::VARCHAR AS found"))(
    lambda spark, d: tables.read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.array_join(T.tickets(F.concat(F.lit("see ABC-"), "conv_id", F.lit(" and #"), "turn", F.lit(" ABC-"), "conv_id")), ", "), F.lit("]")).alias("found")))
query("templatize_docs")(lambda spark, d: tables.read(spark, d, "documents").select("doc_id", T.templatize(F.col("text")).alias("template")))
query("redact_docs")(lambda spark, d: tables.read(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"), T.secrets(F.col("text")).alias("secrets")))
query("simhash_docs")(lambda spark, d: tables.read(spark, d, "documents").select("doc_id", T.simhash(F.col("text")).alias("simhash")))
_HASHED = "h AS (SELECT event_id AS rid, event_id * 2654435761 % 65536 + (user_id % 7) * 144115188075855872 AS h FROM events)"
_hashes = lambda spark, d: tables.read(spark, d, "events").select(F.col("event_id").alias("rid"), (F.col("event_id") * 2654435761 % 65536 + (F.col("user_id") % 7) * 144115188075855872).alias("h"))
query("similar_hamming", f"WITH {_HASHED} SELECT 'ev:' || a.rid AS id, bit_count(xor(a.h, b.h)) AS distance FROM h a, h b WHERE b.rid = 50 AND a.rid <> 50 AND a.h <> 0 AND bit_count(xor(a.h, b.h)) <= 4 ORDER BY 2, a.rid LIMIT 15")(
    lambda spark, d: search.similar(_with_hashes(spark, d), "ev:50 ").select("id", F.col("distance").cast("int").alias("distance")))


def _with_hashes(spark: SparkSession, sf_dir: str) -> Store:
    s = tables.log_store(spark, sf_dir)
    hashed = s.events.drop("simhash").join(_hashes(spark, sf_dir).withColumnRenamed("h", "simhash"), "rid")
    return Store.of(hashed.withColumn("id", F.when(F.col("rid") == 50, "ev:50 ").otherwise(F.col("id"))))


query("simhash_bands", f"WITH {_HASHED}, n AS (SELECT h, min(rid) AS rid FROM h GROUP BY h) SELECT a.rid AS a, b.rid AS b, bit_count(xor(a.h, b.h)) AS distance FROM n a JOIN n b ON a.rid < b.rid AND bit_count(xor(a.h, b.h)) <= 1")(
    lambda spark, d: search.similar_pairs(_hashes(spark, d), 1).select("a", "b", F.col("distance").cast("int").alias("distance")))

# --- sources: the log events written as lines, and read back --------------------------------------


def _lines(spark: SparkSession, sf_dir: str, line) -> DataFrame:  # noqa: ANN001
    e = tables.read(spark, sf_dir, "events").withColumn("ms", tables.ms("ts"))
    return e.select(line.alias("line"), F.lit("x").alias("file"), F.col("event_id").alias("place"))


def _read(df: DataFrame) -> DataFrame:
    return df.select("place", "at_ms", "title", "level", F.col("touches")[0]["entity"].alias("entity"))


_who = lambda: F.concat(F.lit("svc-"), F.col("user_id").cast("string"))  # noqa: E731  columns need a session
_level = lambda: F.substring("event_type", 1, 4).alias("level")
_SECONDS = "(epoch_us(ts) // 1000000 * 1000)"
_BACK = "SELECT event_id AS place, {0} AS at_ms, event_type AS title, {1} AS level, 'svc-' || user_id AS entity FROM events"
_UP = "upper(substr(event_type, 1, 4))"


@query("source_jsonl", _BACK.format("epoch_us(ts) // 1000", _UP))
def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("ms").alias("ts"), F.col("event_type").alias("msg"), _level(), _who().alias("service")))
    return _read(jsonl.parse(_lines(spark, sf_dir, line)))


@query("source_jsonl_explode", "SELECT event_id AS place, count(*) AS events, string_agg(title, ',' ORDER BY title) AS titles FROM (SELECT event_id, event_type || '-a' AS title FROM events UNION ALL SELECT event_id, event_type || '-b' FROM events) GROUP BY 1")
def _jsonl_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda x, keep: F.struct(F.concat("event_type", F.lit(x)).alias("msg"), F.lit(keep).alias("type"))
    line = F.to_json(F.struct(F.col("ms").alias("ts"), F.array(item("-a", "use"), item("-b", "use"), item("-c", "skip")).alias("items")))
    rows = jsonl.parse(_lines(spark, sf_dir, line), jsonl.Fields(explode="items", explode_where=("type=use",)))
    return rows.groupBy("place").agg(F.count_distinct("id").alias("events"), F.array_join(F.array_sort(F.collect_list("title")), ",").alias("titles"))


@query("source_csv", _BACK.format("epoch_us(ts) // 1000", _UP))
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(",", F.col("ms").cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"')), _level(), _who())
    return _read(text.csv(_lines(spark, sf_dir, line), "ts,msg,level,service"))


@query("source_template", _BACK.format("epoch_us(ts) // 1000", _UP))
def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("ms").cast("string"), F.lit("  "), _level(), F.lit(" ["), _who(), F.lit("] "), "event_type")
    return _read(text.templated(_lines(spark, sf_dir, line), "<time> <level> [<svc>] <message>"))


@query("source_syslog", _BACK.format(_SECONDS, "CASE event_id % 8 WHEN 0 THEN 'EMERG' WHEN 1 THEN 'ALERT' WHEN 2 THEN 'CRIT' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARN' WHEN 5 THEN 'NOTICE' WHEN 6 THEN 'INFO' ELSE 'DEBUG' END"))
def _syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat(F.lit("<"), (F.col("event_id") % 8 + 32).cast("string"), F.lit(">1 "), stamp, F.lit(" host "), _who(), F.lit(" 7 - - "), "event_type")
    return _read(text.syslog(_lines(spark, sf_dir, line)))


@query("source_access", f"SELECT event_id AS place, {_SECONDS} AS at_ms, 'GET /' || event_type || '?u=' || user_id || ' ' || (200 + event_id % 4 * 100) AS title, CASE event_id % 4 WHEN 2 THEN 'WARN' WHEN 3 THEN 'ERROR' ELSE 'INFO' END AS level, '/' || event_type AS entity FROM events")
def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format(F.timestamp_millis("ms"), "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(F.lit("1.2.3.4 - - ["), stamp, F.lit(' +0000] "GET /'), "event_type", F.lit("?u="), F.col("user_id").cast("string"), F.lit(' HTTP/1.1" '), (F.col("event_id") % 4 * 100 + 200).cast("string"), F.lit(' 10 "-" "ua"'))
    return _read(text.access(_lines(spark, sf_dir, line)))


@query("source_git", "SELECT o_orderkey AS place, epoch_us(o_orderdate) // 1000000 * 1000 AS at_ms, 'fix: order #' || o_custkey AS title, '' AS level, 'src/' || o_orderstatus || '.py' AS entity FROM orders")
def _git(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    line = F.concat_ws("\x1f", sha, F.lit("A"), F.lit("a@x"), F.floor(tables.ms("o_orderdate") / 1000).cast("string"), F.lit(""), F.concat(F.lit("fix: order #"), F.col("o_custkey").cast("string")), F.lit(""), F.concat(F.lit("\n1\t2\tsrc/"), "o_orderstatus", F.lit(".py")))
    return _read(text.git_log(o.select(line.alias("line"), F.lit("x").alias("file"), F.col("o_orderkey").alias("place"))))


@query("ingest_dedupe", "SELECT count(*) AS events, count(DISTINCT event_id % 500) AS ids, sum(CAST(event_id AS HUGEINT))::BIGINT AS places FROM (SELECT min(event_id) AS event_id FROM events GROUP BY event_id % 500)")
def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct((F.col("event_id") % 500).cast("string").alias("id"), F.col("ms").alias("ts"), F.col("event_id").cast("string").alias("msg")))
    events = ingest(jsonl.parse(_lines(spark, sf_dir, line))).events
    return events.agg(F.count("*").alias("events"), F.count_distinct("id").alias("ids"), F.sum(F.col("title").cast("long")).alias("places"))


_log("rollup_top_kind", f"SELECT kind AS value, count(*) AS count FROM ev WHERE at_ms >= {FROM} AND at_ms < {TO} AND level = 'INFO' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", lambda s: rollups.top_from(rollups.build(s), s, "kind", Scope(since=FROM, until=TO, level="INFO")))
_log("report_logs", None, lambda s: reports.log_report(s))
query("report_code")(lambda spark, d: reports.code_report(tables.order_store(spark, d), _part(spark, d)))

# --- templates, days, ids -------------------------------------------------------------------------


def _templated(s: Store) -> Store:
    """The log events with the templates that their titles give, not those that the projection knows."""
    return Store.of(s.events.withColumn("template", T.templatize(F.col("title"))), touches=s.touches, links=s.links, labels=s.labels, entities=s.entities)


_log("patterns_templatized", "SELECT template, count(*) AS count, arg_max(id, rid) AS example_id FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", lambda s: counting.patterns(_templated(s)).select("template", "count", "example_id"))
_log("bare_templates", "SELECT template, count(*) AS events FROM ev GROUP BY 1", lambda s: s.events.groupBy(T.bare_template(F.concat(F.lit("<TS> UTC [<NUM>] <TS> "), "template")).alias("template")).agg(F.count("*").alias("events")))
_log("utc_days", "SELECT strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d') AS day, count(*) AS events FROM ev GROUP BY 1", lambda s: s.events.groupBy(times.utc_date(F.col("at_ms")).alias("day")).agg(F.count("*").alias("events")))
query("job_days", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN '2024-05-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, count(*) AS jobs FROM orders GROUP BY 1")(
    lambda spark, d: tables.read(spark, d, "orders").groupBy(times.day_of(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("202405"), F.lpad((F.col("o_orderkey") % 28 + 1).cast("string"), 2, "0"), F.lit("-job"))).otherwise(F.concat(F.lit("j2024-"), F.col("o_orderkey").cast("string"))), tables.ms("o_orderdate")).alias("day")).agg(F.count("*").alias("jobs")))
_log("short_ids", "SELECT left(id, 8) AS short, count(*) AS events FROM ev GROUP BY 1", lambda s: s.events.groupBy(T.short_id(F.col("id")).alias("short")).agg(F.count("*").alias("events")))
_log("longest_literals", "SELECT kind || ' value' AS literal, count(*) AS events FROM ev GROUP BY 1", lambda s: s.events.groupBy(T.longest_literal(F.concat(F.lit("<TS> ["), "kind", F.lit(" value]: <NUM> x"))).alias("literal")).agg(F.count("*").alias("events")))
query("top_segments", "SELECT o_orderkey AS rid, array_to_string(list_sort(list_distinct(['a' || o_custkey % 3, 'b', o_orderstatus])), ',') AS segments FROM orders")(
    lambda spark, d: tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.array_join(T.top_segments(F.array(F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string"), F.lit("/x/y")), F.lit("b"), F.concat_ws("/", "o_orderstatus", F.lit("z")), F.lit("/"), F.lit("b/c"))), ",").alias("segments")))
query("clean_bodies", "SELECT o_orderkey AS rid, 'keep ' || o_custkey || chr(10) || 'last' AS body FROM orders")(
    lambda spark, d: tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), T.clean_body(F.concat(F.lit("  keep "), F.col("o_custkey").cast("string"), F.lit("\n\nSigned-off-by: a\nCloses: #1\nsee https://x.org\nusers.noreply.x\r\n\tlast "))).alias("body")))
query("check_other_sources", "SELECT count(DISTINCT role) - 1 AS sources FROM conversations")(
    lambda spark, d: counting.other_timed_sources(tables.chat_store(spark, d), tables.chat_store(spark, d).events.orderBy("rid").first()["id"]))
_log("index_hash", "SELECT left(md5('events=' || count(*) || '=' || max(rid) || '=' || max(at_ms)), 8) AS hash FROM ev", lambda s: counting.index_hash(s))
_log("show", """, e AS (SELECT * FROM ev WHERE id LIKE 'ev:1%' ORDER BY id LIMIT 1), f AS (
    SELECT unnest([{'field': 'id', 'value': id}, {'field': 'source', 'value': source}, {'field': 'kind', 'value': kind}, {'field': 'at_ms', 'value': at_ms::VARCHAR}, {'field': 'actor', 'value': actor}, {'field': 'title', 'value': title},
        {'field': 'level', 'value': level}, {'field': 'template', 'value': template}, {'field': 'attr:k', 'value': k}, {'field': 'entity', 'value': entity}, {'field': 'link:user', 'value': usr}]) AS x FROM e)
    SELECT x.field AS field, x.value AS value FROM f WHERE x.value <> ''""", lambda s: counting.show(s, "ev:1").where("field <> 'attr:value'"))

# --- sources and steps of ingest, written as lines and read back -----------------------------------


def _order_lines(spark: SparkSession, sf_dir: str, line) -> DataFrame:  # noqa: ANN001
    return tables.read(spark, sf_dir, "orders").withColumn("ms", tables.ms("o_orderdate")).select(line.alias("line"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), F.col("o_orderkey").alias("place"))


_iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
_text = lambda c: F.col(c).cast("string")


@query("source_changelog", "SELECT 'v' || o_orderkey || '.0' AS title, epoch_us(date_trunc('day', o_orderdate)) // 1000 AS at_ms, 2 AS sections, 3 AS bullets FROM orders")
def _changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("# Changes\n\n## [v"), _text("o_orderkey"), F.lit(".0] - "), F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd"), F.lit("\n\n### Added\n- a\n- b\n\n### Fixed\n* c\n\n### Empty\n"))
    out = text.changelog(_order_lines(spark, sf_dir, line))
    return out.select("title", "at_ms", F.size("touches").alias("sections"), F.aggregate("touches", F.lit(0).cast("long"), lambda n, t: n + t["weight"]).alias("bullets"))


_SEVERITY = "CASE event_id % 8 WHEN 0 THEN 'EMERG' WHEN 1 THEN 'ALERT' WHEN 2 THEN 'CRIT' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARN' WHEN 5 THEN 'NOTICE' WHEN 6 THEN 'INFO' ELSE 'DEBUG' END"


@query("source_journal", _BACK.format("epoch_us(ts) // 1000", _SEVERITY))
def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("event_type").alias("MESSAGE"), (F.col("event_id") % 8).cast("string").alias("PRIORITY"), (F.col("ms") * 1000).cast("string").alias("__REALTIME_TIMESTAMP"), _who().alias("SYSLOG_IDENTIFIER")))
    return _read(text.journal(_lines(spark, sf_dir, line)))


@query("source_nod", "SELECT 'nod:i' || user_id || ':r:' || event_id AS id, 'nod.tool.result' AS kind, epoch_us(ts) // 1000 AS at_ms, 'tool.result ' || event_type AS title, CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, 'tool/' || event_type AS entity FROM events")
def _nod(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.create_map(F.lit("tool"), F.col("event_type"), F.lit("ok"), F.when(F.col("event_id") % 3 == 0, "false").otherwise("true"))
    one = F.struct(F.col("event_id").alias("seq"), _iso("ms").alias("ts"), F.lit("tool.result").alias("type"), F.lit("s").alias("session"), data.alias("data"))
    line = F.to_json(F.struct(F.lit(1).alias("nod"), F.struct(F.concat(F.lit("i"), _text("user_id")).alias("instance"), F.lit("r").alias("run")).alias("source"), F.array(one).alias("events")))
    out = text.envelopes(_lines(spark, sf_dir, line))
    return out.select("id", "kind", "at_ms", "title", "level", F.col("touches")[0]["entity"].alias("entity"))


@query("source_jobs", """SELECT 'job:' || o_orderkey || ':start' AS id, 'delega.job.start' AS kind, epoch_us(o_orderdate) // 1000 AS at_ms, 'c' || o_custkey AS actor FROM orders
    UNION ALL SELECT 'job:' || o_orderkey || ':end', 'delega.job.end', epoch_us(o_orderdate) // 1000 + 60000, 'c' || o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def _job_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders").withColumn("ms", tables.ms("o_orderdate"))
    line = F.concat(F.lit("owner=c"), _text("o_custkey"), F.lit("\nstarted="), _iso("ms"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("\nended="), _iso(F.col("ms") + 60000))).otherwise(""))
    return text.jobs(o.select(_text("o_orderkey").alias("job"), line.alias("line"), F.col("o_orderkey").alias("place"))).select("id", "kind", "at_ms", "actor")


@query("tracker_issues", """SELECT o_custkey AS number, 'pr' AS kind, 'Order ' || max(o_orderkey) AS title, arg_max(lower(o_orderstatus), o_orderkey) AS state, arg_max(o_orderstatus = 'F', o_orderkey) AS merged, arg_max(o_orderkey % 2 = 0, o_orderkey) AS is_bug FROM orders GROUP BY 1""")
def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderkey") % 2 == 0, "bug").otherwise("docs")
    line = F.to_json(F.struct(F.col("o_custkey").alias("number"), F.concat(F.lit("Order "), _text("o_orderkey")).alias("title"), F.col("o_orderstatus").alias("state"), F.when(F.col("o_orderstatus") == "F", _iso("ms")).alias("mergedAt"), F.array(F.struct(label.alias("name"))).alias("labels")))
    return commands.issues(_order_lines(spark, sf_dir, line), "pr").select("number", "kind", "title", "state", "merged", "is_bug")


@query("ingest_labels", """SELECT o_orderkey AS rid, 'kind' AS task, CASE o_orderkey % 3 WHEN 0 THEN 'fix' ELSE 'docs' END AS label, 1.0::DOUBLE AS confidence FROM orders WHERE o_orderkey % 3 < 2
    UNION ALL SELECT o_orderkey, 'is_fix', CASE o_orderkey % 3 WHEN 0 THEN 'true' ELSE 'false' END, 1.0::DOUBLE FROM orders""")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("o_orderkey") % 3 == 0, "fix(core)!: one").when(F.col("o_orderkey") % 3 == 1, "docs: two").otherwise("three")
    rows = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), F.lit("commit").alias("kind"), title.alias("title"), F.lit("Fixes: a crash\nhttps://bug.org/error").alias("body"))
    return labels_of(rows, Options()).select("rid", "task", "label", "confidence")


@query("ingest_label_chain", """SELECT o_orderkey AS rid, 'kind' AS task, CASE WHEN o_orderkey % 3 = 0 THEN 'fix' ELSE lower(o_orderstatus) END AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'one' ELSE 'two' END AS src FROM orders
    UNION ALL SELECT o_orderkey, 'area', 'core', 'one' FROM orders WHERE o_orderkey % 3 = 0""")
def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "rid")
    said = lambda rows, task, label, src: rows.select("rid", F.lit(task).alias("task"), label.alias("label"), F.lit(0.5).alias("confidence"), F.lit(src).alias("src"), F.lit("").alias("evidence"))
    some = o.where("rid % 3 = 0")
    one = said(some, "kind", F.lit("fix"), "one").union(said(some, "area", F.lit("core"), "one"))
    return chained(one, said(o, "kind", F.lower("o_orderstatus"), "two")).select("rid", "task", "label", "src")


@query("ingest_entity_via", """WITH r AS (SELECT event_id AS rid, user_id AS target, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'u/' || event_id % 7 END AS e FROM events),
    f AS (SELECT target, arg_min(e, rid) AS known FROM r WHERE e <> 'unknown' GROUP BY 1) SELECT rid, CASE WHEN e = 'unknown' THEN coalesce(known, e) ELSE e END AS entity FROM r LEFT JOIN f USING (target)""")
def _via(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, "unknown").otherwise(F.concat(F.lit("u/"), (F.col("event_id") % 7).cast("string")))
    touch = F.struct(name.alias("entity"), F.lit("user").alias("type"), F.lit(1).cast("long").alias("weight"))
    rows = e.select(F.col("event_id").alias("rid"), F.array(F.struct(F.lit("who").alias("rel"), _text("user_id").alias("target"))).alias("links"), F.array(touch).alias("touches"))
    return via(rows, "who").select("rid", F.col("touches")[0]["entity"].alias("entity"))


@query("branches", """WITH r AS (SELECT 'b' || o_custkey % 20 AS branch, CASE WHEN o_orderkey % 3 = 0 THEN 'behind' ELSE 'ahead' END AS side, o_orderpriority AS author, o_orderkey AS "at" FROM orders),
    c AS (SELECT branch, author, count(*) AS n FROM r WHERE side = 'ahead' GROUP BY 1, 2),
    k AS (SELECT branch, row_number() OVER w AS k, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY branch) AS ahead FROM c WINDOW w AS (PARTITION BY branch ORDER BY n DESC, author)),
    f AS (SELECT branch, min(k) FILTER (upto * 2 > ahead) AS bus_factor, count(*) AS authors, any_value(ahead)::BIGINT AS ahead FROM k GROUP BY 1)
    SELECT branch, ahead, count(*) FILTER (side = 'behind') AS behind, (SELECT max("at") FROM r) - max("at") >= 50 AS stale, authors, bus_factor FROM r JOIN f USING (branch) GROUP BY branch, ahead, authors, bus_factor""")
def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("o_orderkey") % 3 == 0, "behind").otherwise("ahead")
    revs = tables.read(spark, sf_dir, "orders").select(F.concat(F.lit("b"), (F.col("o_custkey") % 20).cast("string")).alias("branch"), side.alias("side"), _text("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("author"), F.col("o_orderkey").alias("at_ms"))
    return code.branches(revs, stale=50).select("branch", "ahead", "behind", "stale", "authors", "bus_factor")


@query("job_failures", """WITH j AS (SELECT *, o_orderkey % 11 = 0 AS refused, o_orderkey % 13 AS rc, o_orderkey % 17 <> 0 AS ended, o_orderkey % 5 <> 0 AS has_output FROM orders), n AS (SELECT max(o_orderkey) AS newest FROM j)
    SELECT * FROM (SELECT o_orderkey AS job, CASE WHEN refused THEN 'refused' WHEN rc IN (2, 3, 4, 5, 8, 9) THEN 'launch' WHEN ended AND NOT has_output THEN 'no_output' WHEN NOT ended AND newest - o_orderkey > 100 THEN 'never_ended' END AS reason FROM j, n) WHERE reason IS NOT NULL""")
def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = tables.read(spark, sf_dir, "orders").select(k.alias("job"), (k % 11 == 0).alias("refused"), (k % 13).alias("rc"), k.alias("started_ms"), F.when(k % 17 != 0, k).alias("ended_ms"), k.alias("last_ms"), (k % 5 != 0).alias("has_output"))
    return process.failures(rows, stale=100)


# --- what groups delivered -----------------------------------------------------------------------

_DONE = f"""{_TOUCH}, c AS (SELECT rid, o_custkey % 40 AS key, o_orderstatus = 'F' AS mine, entity, at_ms AS "at", added + deleted AS w, size FROM t JOIN o USING (rid) JOIN orders ON o_orderkey = rid),
    l AS (SELECT DISTINCT a.key, b.rid, b.entity, b.w FROM c a JOIN c b ON a.entity = b.entity AND b."at" > a."at" AND b."at" <= a."at" + {30 * DAY} AND NOT (b.mine AND b.key = a.key) WHERE a.mine),
    h AS (SELECT entity FROM c GROUP BY entity ORDER BY count(*) * greatest(any_value(size), 1) DESC, entity LIMIT 25),
    f AS (SELECT key, count(DISTINCT entity) AS files, sum(w)::BIGINT AS lines, count(DISTINCT entity) FILTER (entity IN (FROM h)) AS hotspots FROM c WHERE mine GROUP BY key),
    r AS (SELECT key, count(DISTINCT entity) AS files_reworked, sum(w)::BIGINT AS lines_reworked FROM l GROUP BY key),
    n AS (SELECT o_custkey % 40 AS key, count(*) AS commits, count(*) FILTER (epoch_us(o_orderdate) // 1000 + {30 * DAY} > 1640995200000) AS open_windows FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


def _revisions(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """The orders as commits with hexadecimal ids, and the groups (customers, in 40) that delivered the finished ones."""
    s = tables.order_store(spark, sf_dir)
    o = tables.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    made = Store.of(s.events.withColumn("id", F.md5(_text("rid"))), touches=s.touches, entities=s.entities)
    return made, o.select((F.col("o_custkey") % 40).alias("key"), F.left(F.md5(_text("o_orderkey")), F.lit(16)).alias("sha"))


@query("session_delivery", f"WITH {_DONE} SELECT n.key, commits, 0 AS unresolved, files, lines, hotspots, coalesce(files_reworked, 0) AS files_reworked, coalesce(lines_reworked, 0) AS lines_reworked, open_windows, round(coalesce(files_reworked, 0) / files, 6) AS file_ratio FROM n JOIN f USING (key) LEFT JOIN r USING (key)")
def _delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, shas = _revisions(spark, sf_dir)
    out = delivery.delivered(s, shas, "order", horizon=1_640_995_200_000, hot=code.hotspots(s))
    return out.withColumn("file_ratio", F.round("file_ratio", 6))


_EDITS = """e AS (SELECT DISTINCT l_suppkey AS key, CASE WHEN l_linenumber = 7 THEN '/tmp/x' ELSE '/src/' || p_brand || '/part/' || p_partkey END AS path, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT DISTINCT l_suppkey AS key, CASE p_brand WHEN 'Brand#11' THEN '' ELSE p_brand || '/' END || 'part/' || p_partkey AS entity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
    r AS (SELECT DISTINCT key, path, CASE WHEN path <> '/tmp/x' THEN CASE p_brand WHEN 'Brand#11' THEN path[15:] ELSE path[6:] END END AS entity FROM e)"""


@query("session_incomplete", f"WITH {_EDITS} SELECT key, count(DISTINCT r.entity) AS edited, count(DISTINCT r.entity) FILTER (c.entity IS NULL) AS uncommitted, count(DISTINCT path) FILTER (r.entity IS NULL) AS outside FROM r LEFT JOIN c USING (key, entity) GROUP BY key")
def _incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.concat_ws("/", F.lit("part"), _text("p_partkey")).alias("file"))
    lines = tables.read(spark, sf_dir, "lineitem").join(parts, "l_partkey").withColumn("key", F.col("l_suppkey"))
    path = F.when(F.col("l_linenumber") == 7, "/tmp/x").otherwise(F.concat_ws("/", F.lit("/src"), "p_brand", "file"))
    entity = F.when(F.col("p_brand") == "Brand#11", F.col("file")).otherwise(F.concat_ws("/", "p_brand", "file"))
    roots = spark.createDataFrame([(None, "/src/"), (None, "/src/Brand#11")], "key long, root string")
    return delivery.incomplete(lines.select("key", path.alias("path")), roots, lines.where("l_returnflag = 'R'").select("key", entity.alias("entity")))


_MERGES = """s AS (SELECT o_custkey AS key, o_orderpriority AS branch, CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN false WHEN '5-LOW' THEN true END AS state, o_orderkey FROM orders),
    g AS (SELECT key, coalesce(bool_or(state) FILTER (branch <> '5-LOW'), bool_or(state)) AS done, bool_or(o_orderkey % 16 = 0) FILTER (o_orderkey % 8 < 2) AS pull FROM s GROUP BY key),
    m AS (SELECT key, CASE WHEN coalesce(pull, false) OR done THEN 'merged' WHEN done IS NOT NULL OR pull IS NOT NULL THEN 'not_merged' ELSE 'unknown' END AS status, CASE WHEN pull THEN 'pr' WHEN done IS NOT NULL THEN 'branch' WHEN pull IS NOT NULL THEN 'pr' ELSE '' END AS via FROM g)"""


def _merge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey"))
    states = spark.createDataFrame([("1-URGENT", True), ("2-HIGH", False), ("5-LOW", True)], "branch string, merged boolean")
    pulls = o.where("o_orderkey % 8 < 2").select("key", (F.col("o_orderkey") % 16 == 0).alias("merged"))
    return delivery.merges(o, o.select("key", F.col("o_orderpriority").alias("branch")), states, pulls, base="5-LOW")


query("session_merges", f"WITH {_MERGES} SELECT key, status, via FROM m")(_merge_states)
query("session_merge_rate", f"WITH {_MERGES} SELECT count(*) FILTER (status <> 'unknown') AS known, count(*) FILTER (status = 'merged') AS merged, round(count(*) FILTER (status = 'merged') / count(*) FILTER (status <> 'unknown'), 6) AS rate FROM m")(
    lambda spark, d: delivery.merge_rate(_merge_states(spark, d)).withColumn("rate", F.round("rate", 6)))


@query("session_ranking", "SELECT o_custkey AS key, max(CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 100000) END) AS cost, count(*) AS tokens, max(CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 100000) END) / count(*) AS cost_per_commit FROM orders GROUP BY 1 ORDER BY coalesce(max(CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 100000) END), -1) DESC, tokens DESC, key LIMIT 25")
def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.when(F.col("o_orderkey") % 2 == 0, F.floor(F.col("o_totalprice") / 100000).cast("double"))
    groups = tables.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max(cost).alias("cost"), F.count("*").alias("tokens"))
    return delivery.ranked(groups.withColumn("cost_per_commit", delivery.per_commit("cost", "tokens")))


# --- tags, sizes, suggestions --------------------------------------------------------------------


@query("tag_markers", "SELECT 'v' || o_custkey AS name, arg_max(epoch_us(o_orderdate) // 86400000000 * 86400000, o_orderkey) AS at_ms, arg_max('r' || o_orderkey, o_orderkey) AS ref FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1")
def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("v"), _text("o_custkey"))).otherwise("")
    line = F.concat_ws("\x1f", name, F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("r"), _text("o_orderkey")))
    return commands.tags(_order_lines(spark, sf_dir, line)).select("name", "at_ms", "ref")


@query("sized_entities", "SELECT p_brand || '/part/' || p_partkey AS entity, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 0 ELSE p_size * 2 END::BIGINT AS size, p_partkey % 3 = 0 AS deleted FROM part")
def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = F.when(k % 3 == 1, "-").otherwise((F.col("p_size") * 2).cast("string"))
    line = F.when(k % 3 == 0, "no line of a tree").otherwise(F.concat_ws("\t", lines, F.lit("0"), F.concat_ws("/", "p_brand", F.lit("part"), _text("p_partkey"))))
    tree = tables.read(spark, sf_dir, "part").select(line.alias("line"))
    return commands.sized(tables.order_store(spark, sf_dir).entities, tree).select("entity", "size", "deleted")


query("closest_names", "SELECT DISTINCT c_name AS value, levenshtein(lower(c_name), 'customer#000000120') AS distance FROM customer WHERE levenshtein(lower(c_name), 'customer#000000120') <= 2 ORDER BY 2, 1 LIMIT 25")(
    lambda spark, d: counting.closest(tables.read(spark, d, "customer").select(F.col("c_name").alias("value")), "customer#000000120", limit=25))
