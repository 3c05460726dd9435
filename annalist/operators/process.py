"""Metrics of processes: streaks of failures, running costs, latencies, rework, sessions and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .episodes import in_windows


def streaks(rows: DataFrame, keys: list[str], order: list[str], failed: Column, least: int = 3) -> DataFrame:
    """``keys``, ``length``, ``first_at``, ``last_at`` of runs of at least ``least`` failures in a row.

    ``order`` starts with the time. A run ends where a row of the same keys isn't a failure.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("__failed", F.coalesce(failed, F.lit(False)))
    runs = marked.withColumn("__run", F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(w)).where("__failed")
    return runs.groupBy(*keys, "__run").agg(F.count("*").alias("length"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at")).where(F.col("length") >= least).drop("__run")


def deltas(rows: DataFrame, keys: list[str], order: list[str], total: str) -> DataFrame:
    """``rows`` with ``delta``: what a running total grew by; after a reset, the new total."""
    before = F.lag(total).over(Window.partitionBy(*keys).orderBy(*order))
    c = F.col(total)
    return rows.withColumn("delta", F.when(before.isNull() | (c < before), c).otherwise(c - before))


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, taker: Column) -> DataFrame:
    """``rows`` with ``carried``: at each taker, the last value since the taker before; each is taken once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    spans = rows.withColumn("__value", value).withColumn("__taker", F.coalesce(taker, F.lit(False)))
    spans = spans.withColumn("__n", F.sum(F.col("__taker").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__n", F.coalesce("__n", F.lit(0)))
    last = F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys, "__n").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("carried", F.when(F.col("__taker"), last)).drop("__value", "__taker", "__n")


def following(rows: DataFrame, keys: list[str], asks: Column, answers: Column, at: str = "at_ms") -> DataFrame:
    """Asking rows with ``latency``: ms to the next answer of the same keys, at the same time or later."""
    marked = rows.withColumn("__asks", F.coalesce(asks, F.lit(False))).withColumn("__answer", F.when(answers, F.col(at)))
    # answers at the same time come after, so a range frame from the current row takes them in
    ahead = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return marked.withColumn("__next", F.min("__answer").over(ahead)).where("__asks").withColumn("latency", F.col("__next") - F.col(at)).drop("__asks", "__answer", "__next")


def latency_summary(latencies: DataFrame, keys: list[str], slow: int = 1_800_000) -> DataFrame:
    """``n``, ``p50``, ``p90``, ``max`` (nearest rank) and how many took over ``slow`` ms."""
    return latencies.where("latency IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency)").alias("p50"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY latency)").alias("p90"),
        F.max("latency").alias("max"),
        F.count(F.when(F.col("latency") > slow, 1)).alias("slow"),
    )


def rework(changes: DataFrame, span: int) -> DataFrame:
    """``group``, ``entity``, ``pairs``: later changes of an entity by other groups within ``span`` ms.

    ``changes`` has ``rid``, ``group``, ``entity``, ``at_ms``. A range join on slabs of time.
    """
    spans = changes.select("entity", F.col("group").alias("g"), F.col("rid").alias("r"), (F.col("at_ms") + 1).alias("lo"), (F.col("at_ms") + span + 1).alias("hi"))
    later = in_windows(changes.select("entity", "group", "rid", "at_ms"), spans, ["entity"], span).where("group <> g")
    return later.select(F.col("g").alias("group"), "entity", "r", "rid").distinct().groupBy("group", "entity").agg(F.count("*").alias("pairs"))


def _num(key: str) -> Column:
    return F.expr(f"try_cast(attrs['{key}'] AS DOUBLE)")


def sessions(events: DataFrame, by: str = "session") -> DataFrame:
    """Totals of agent telemetry by ``session``, by ``task``, or over all (``''``).

    ``events`` are rows of the event model of kinds ``nod.<type>``, whose attrs hold ``session``, ``task``,
    ``tokens``, ``cost``, ``duration_ms``, ``wait_ms``, ``by``, ``agent``, ``tool``, ``ok``. Costs are running
    totals of a session, instance and run, and may start anew. Time is that of the main agent's
    turns; a turn that isn't ended lasts to its last event.
    """
    rows = events.select(
        "rid", "at_ms", F.regexp_replace("kind", "^nod\\.", "").alias("type"),
        *(F.coalesce(F.col("attrs")[k], F.lit("")).alias(k) for k in ("session", "task", "instance", "run", "turn", "agent", "tool", "by", "state", "decision")),
        F.coalesce(F.col("attrs")["ok"], F.lit("true")).alias("ok"),
        *(_num(k).alias(k) for k in ("tokens", "cost", "duration_ms", "wait_ms", "seq")),
    )
    where = ["instance", "run", "session"]
    costs = deltas(rows.where("cost IS NOT NULL"), where, ["at_ms", "seq", "rid"], "cost").groupBy("rid").agg(F.sum("delta").alias("spent"))
    main = (F.col("agent").isin("", "main"))
    turn = rows.where(main & (F.col("turn") != "")).groupBy(*where, "turn").agg(
        F.max("task").alias("task"),
        F.min(F.when(F.col("type") == "turn.start", F.col("at_ms"))).alias("began"),
        F.max("at_ms").alias("last"),
        F.max(F.when(F.col("type") == "turn.end", F.col("duration_ms"))).alias("took"),
        F.max(F.when((F.col("type") == "turn.end") & (F.col("state") == "aborted"), 1).otherwise(0)).alias("aborted"),
    )
    keys = [by] if by else []
    spent = rows.join(costs, "rid", "left").groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.sum(F.when(F.col("type") == "turn.step", F.col("tokens"))).alias("tokens"),
        F.sum("spent").alias("cost"),
        F.sum(F.when(F.col("by").isin("user", "remote"), F.col("wait_ms"))).alias("wait_ms"),
        F.count(F.when(F.col("type") == "permission.ask", 1)).alias("asked"),
        F.count(F.when(F.col("decision") == "deny", 1)).alias("denied"),
    )
    ran = turn.groupBy(*keys).agg(F.sum(F.coalesce("took", F.col("last") - F.col("began"))).alias("agent_ms"), F.sum("aborted").alias("interruptions"))
    loops = streaks(rows.where("type = 'tool.result'"), sorted({"session", "task", "agent", "tool"} | set(keys)), ["at_ms", "seq", "rid"], (F.col("ok") == "false") & (F.col("decision") != "deny"))
    looped = loops.groupBy(*keys).agg(F.count("*").alias("loops"))
    if keys:
        return spent.join(ran, keys, "left").join(looped, keys, "left").fillna(0, ["loops", "interruptions"])
    return spent.crossJoin(ran).crossJoin(looped)  # one row each


def spend(jobs: DataFrame, by: str) -> DataFrame:
    """``key``, ``jobs``, ``cost``, ``cost_per_job`` of jobs by a column; '?' stands for an empty key."""
    key = F.when(F.coalesce(by, F.lit("")) == "", "?").otherwise(F.col(by).cast("string"))
    out = jobs.groupBy(key.alias("key")).agg(F.count("*").alias("jobs"), F.sum("cost").alias("cost"))
    return out.withColumn("cost_per_job", F.try_divide("cost", "jobs"))


def audit(jobs: DataFrame, entries: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """``job``, ``cost``, ``audited``, ``state``: whether each job's cost is what the audit says."""
    both = jobs.select("job", "cost").join(entries.groupBy("job").agg(F.max("cost_usd").alias("audited")), "job", "full_outer")
    state = (
        F.when(F.col("audited").isNull(), "not_audited")
        .when(F.col("cost").isNull(), "only_audited")
        .when(F.abs(F.col("cost") - F.col("audited")) <= tolerance, "match")
        .otherwise("differs")
    )
    return both.withColumn("state", state)


# Exit codes that a launcher gives when a job didn't start.
LAUNCH_CODES = (2, 3, 4, 5, 8, 9)


def failures(jobs: DataFrame, stale: int = 21_600_000) -> DataFrame:
    """``job``, ``reason`` of jobs that failed for reasons outside them; the first that applies.

    ``jobs`` has ``job``, ``refused``, ``rc``, ``started_ms``, ``ended_ms``, ``last_ms``, ``has_output``.
    """
    newest = jobs.agg(F.max("last_ms").alias("newest"))
    idle = F.col("ended_ms").isNull() & (F.col("newest") - F.col("last_ms") > stale)
    reason = (
        F.when(F.col("refused"), "refused")
        .when(F.col("rc").isin(*LAUNCH_CODES), "launch")
        .when(F.col("ended_ms").isNotNull() & ~F.col("has_output"), "no_output")
        .when(idle, "never_ended")
    )
    return jobs.join(F.broadcast(newest), F.lit(True)).select("job", reason.alias("reason")).where("reason IS NOT NULL")
