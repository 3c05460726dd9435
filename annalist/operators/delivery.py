"""What sessions and tasks delivered: commits, rework, edits left out, merges, and the order of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Store

DAY = 86_400_000


def resolved(shas: DataFrame, events: DataFrame) -> DataFrame:
    """``sha``, ``rid``, ``at_ms`` of each sha (four hex digits or more) that begins the id of one event only."""
    short = shas.select("sha").distinct().where(F.col("sha").rlike("^[0-9a-fA-F]{4,}$")).withColumn("p", F.lower(F.left("sha", F.lit(4))))
    named = events.select("rid", "id", "at_ms", F.left("id", F.lit(4)).alias("p"))
    met = short.join(named, "p").where(F.col("id").startswith(F.lower("sha")))
    return met.groupBy("sha").agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.min("at_ms").alias("at_ms")).where("n = 1").drop("n")


def _upto(touches: DataFrame, points: DataFrame, slab: int) -> DataFrame:
    """``points`` (``entity``, ``at``, ...) with ``n`` and ``w``: touches of the entity until then, and their lines.

    Running sums within slabs of time, and over the totals of slabs, so that no task has to hold all
    touches of an entity that nearly every commit changes.
    """
    at = F.floor(F.col("at") / slab).alias("slab")
    sums = touches.groupBy("entity", at).agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    wanted = points.select("entity", "at").distinct()
    slabs = sums.unionByName(wanted.select("entity", at, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w"))).groupBy("entity", "slab").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    before = Window.partitionBy("entity").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    base = slabs.select("entity", "slab", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "w")))
    inside = touches.groupBy("entity", "at").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.lit(False).alias("asked"))
    rows = inside.unionByName(wanted.select("entity", "at", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("asked"))).select("*", at)
    within = Window.partitionBy("entity", "slab").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select("entity", "slab", "at", "asked", F.sum("n").over(within).alias("n"), F.sum("w").over(within).alias("w")).where("asked")
    found = running.join(base, ["entity", "slab"]).select("entity", "at", (F.col("n") + F.col("n0")).alias("n"), (F.col("w") + F.col("w0")).alias("w"))
    return points.join(found, ["entity", "at"])


def rework(own: DataFrame, touches: DataFrame, span: int) -> DataFrame:
    """``key``, ``entity``, ``commits``, ``lines``: what others changed within ``span`` ms of a group's own changes.

    ``own`` and ``touches`` have ``entity``, ``at``, ``w`` (lines), ``own`` also ``key``, and is part of
    ``touches``. A later change counts once for a group and entity, however many of the group's
    changes it follows; the group's own never count. The windows after a group's changes are cut
    where the next one begins, so they don't overlap, and sums until their ends give the totals: no
    pair of commits is formed.
    """
    ordered = Window.partitionBy("key", "entity").orderBy("at")
    marks = own.groupBy("key", "entity", "at").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    marks = marks.withColumn("end", F.least(F.col("at") + span, F.lead("at").over(ordered))).withColumn("end", F.coalesce("end", F.col("at") + span))
    mine = F.col("at") - F.lag("at").over(ordered) <= span  # changes of the group that lie in its own windows
    again = marks.withColumn("mine", F.coalesce(mine, F.lit(False))).where("mine").select("key", "entity", -F.col("n"), -F.col("w"))
    ends = marks.select("key", "entity", F.explode(F.array(F.struct(F.col("end").alias("at"), F.lit(1).alias("sign")), F.struct("at", F.lit(-1).alias("sign")))).alias("p"))
    sums = _upto(touches, ends.select("key", "entity", "p.at", "p.sign"), max(span, 1))
    parts = sums.select("key", "entity", F.col("n") * F.col("sign"), F.col("w") * F.col("sign")).union(again).toDF("key", "entity", "n", "w")
    return parts.groupBy("key", "entity").agg(F.sum("n").alias("commits"), F.sum("w").alias("lines")).where("commits > 0")


def delivered(store: Store, shas: DataFrame, kind: str = "commit", days: int = 30, horizon: int = 0, hot: DataFrame | None = None) -> DataFrame:
    """What each group delivered, from ``shas`` (``key``, ``sha``, full or abbreviated).

    Columns: ``key``, ``commits`` (distinct shas), ``unresolved`` (of these, those that no single event
    of ``kind`` has), ``files``, ``lines`` (delivered), ``files_reworked``, ``lines_reworked`` (changed by others in the
    ``days`` after), ``file_ratio``, ``open_windows`` (commits whose days reach beyond ``horizon``, if that
    is given), ``hotspots`` (files among ``hot``, a table of ``entity``). Ratios are null for a group whose
    shas are all unresolved.
    """
    events = store.events.where(F.col("kind") == kind)
    shas = shas.where("sha <> ''").select("key", "sha").distinct()
    ids = resolved(shas, events)
    mine = shas.join(ids, "sha").select("key", "rid", "at_ms").distinct()
    files = store.touches.join(store.entities.where("type = 'file'").select("entity"), "entity", "left_semi")
    lines = (F.greatest("added", F.lit(0)) + F.greatest("deleted", F.lit(0))).alias("w")
    touches = files.join(events.select("rid", F.col("at_ms").alias("at")), "rid").select("rid", "entity", "at", lines)
    own = touches.join(mine.select("key", "rid"), "rid").select("key", "rid", "entity", "at", "w")
    span = days * DAY
    named = shas.join(ids.select("sha", "rid"), "sha", "left").groupBy("key").agg(F.count("*").alias("commits"), F.count(F.when(F.col("rid").isNull(), 1)).alias("unresolved"))
    late = (F.lit(horizon) > 0) & (F.col("at_ms") + span > horizon)
    open_ = mine.groupBy("key").agg(F.count(F.when(late, 1)).alias("open_windows"))
    listed = own.withColumn("hot", F.lit(False)) if hot is None else own.join(hot.select("entity", F.lit(True).alias("hot")).distinct(), "entity", "left")
    made = listed.groupBy("key", "entity").agg(F.sum("w").alias("w"), F.max("hot").alias("hot")).groupBy("key").agg(F.count("*").alias("files"), F.sum("w").alias("lines"), F.count(F.when(F.col("hot"), 1)).alias("hotspots"))
    redone = rework(own, touches, span).groupBy("key").agg(F.count("*").alias("files_reworked"), F.sum("lines").alias("lines_reworked"))
    out = named.join(open_, "key", "left").join(made, "key", "left").join(redone, "key", "left")
    known = F.col("open_windows").isNotNull()
    counts = [F.when(known, F.coalesce(c, F.lit(0))).alias(c) for c in ("files", "lines", "hotspots", "files_reworked", "lines_reworked", "open_windows")]
    ratio = F.when(known, F.coalesce(F.try_divide("files_reworked", "files"), F.lit(0.0))).alias("file_ratio")
    return out.select("key", "commits", "unresolved", *counts, ratio)


def incomplete(edits: DataFrame, roots: DataFrame, committed: DataFrame) -> DataFrame:
    """``key``, ``edited``, ``uncommitted``, ``outside``: files edited but not committed, by group.

    ``edits`` has ``key``, ``path`` (absolute); ``roots`` has ``key`` (null: of every group), ``root``; ``committed``
    has ``key``, ``entity`` (relative). Of the roots above a path the longest wins. A path is filed under the folders
    above it, so roots are met by an equi-join.
    """
    at = F.expr("transform(sequence(1, size(split(path, '/')) - 1), k -> substring_index(path, '/', k))")
    paths = edits.select("key", "path").distinct()
    above = paths.withColumn("root", F.explode(at)).where("root <> ''")
    known = roots.select(F.col("key").alias("of"), F.rtrim(F.col("root"), F.lit("/")).alias("root")).where("root <> ''").distinct()
    met = above.join(known, "root").where("of IS NULL OR of = key").groupBy("key", "path").agg(F.max(F.length("root")).alias("n"))
    placed = paths.join(met, ["key", "path"], "left").withColumn("entity", F.expr("substring(path, n + 2)"))
    inside = placed.where("n IS NOT NULL").select("key", "entity").distinct()
    left = inside.join(committed.select("key", "entity").distinct(), ["key", "entity"], "left_anti")
    counts = [inside.select("key", F.lit("edited").alias("what")), left.select("key", F.lit("uncommitted").alias("what")), placed.where("n IS NULL").select("key", F.lit("outside").alias("what"))]
    told = counts[0].union(counts[1]).union(counts[2]).groupBy("key")
    return told.agg(*(F.count(F.when(F.col("what") == c, 1)).alias(c) for c in ("edited", "uncommitted", "outside")))


def merges(groups: DataFrame, branches: DataFrame, states: DataFrame, pulls: DataFrame, base: str = "") -> DataFrame:
    """``key``, ``status``, ``via``: whether the work of each of ``groups`` (``key``) was merged.

    ``branches`` has ``key``, ``branch``; ``states`` has ``branch``, ``merged``; ``pulls`` has ``key``, ``merged``. A merged
    pull request decides; then the branches whose state is known, of which ``base`` counts only alone;
    then a request that isn't merged. Else the status is unknown.
    """
    told = branches.select("key", "branch").distinct().join(states, "branch")
    other = F.col("branch") != base if base else F.lit(True)
    side = told.groupBy("key").agg(F.max(F.when(other, F.col("merged"))).alias("other"), F.max("merged").alias("any"))
    side = side.select("key", F.coalesce("other", "any").alias("branch"))
    asked = pulls.groupBy("key").agg(F.max("merged").alias("pull"))
    out = groups.select("key").distinct().join(side, "key", "left").join(asked, "key", "left")
    pull, branch = F.coalesce("pull", F.lit(False)), F.col("branch")
    status = F.when(pull, "merged").when(branch, "merged").when(branch.isNotNull() | F.col("pull").isNotNull(), "not_merged").otherwise("unknown")
    via = F.when(pull, "pr").when(branch.isNotNull(), "branch").when(F.col("pull").isNotNull(), "pr").otherwise("")
    return out.select("key", status.alias("status"), via.alias("via"))


def merge_rate(states: DataFrame) -> DataFrame:
    """``known``, ``merged``, ``rate``: the share of merged groups among those whose status is known."""
    known = F.count(F.when(F.col("status") != "unknown", 1))
    merged = F.count(F.when(F.col("status") == "merged", 1))
    return states.agg(known.alias("known"), merged.alias("merged"), F.try_divide(merged, known).alias("rate"))


def per_commit(total: str, commits: str = "commits") -> Column:
    """A total for each commit; null without one."""
    return F.when(F.col(commits) > 0, F.col(total) / F.col(commits))


def ranked(groups: DataFrame, limit: int = 25) -> DataFrame:
    """Groups (``key``, ``cost``, ``tokens``) of most cost first, those without one last; then of most tokens, then by key."""
    return groups.orderBy(F.desc(F.coalesce("cost", F.lit(-1.0))), F.desc(F.coalesce("tokens", F.lit(0))), "key").limit(limit)
