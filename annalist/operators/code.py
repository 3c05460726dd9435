"""Questions about what changes: hotspots, churn, co-change, ownership, fixes, tickets, releases, blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import top_dir
from ..model import Store

#: Recent fixes: of the last 90 days of the history, in ms.
RECENT = 90 * 86_400_000


def _touches(store: Store, since: int, symbols: bool) -> DataFrame:
    """Touches of events since ``since`` (so none of before 1970), of symbols or of anything else."""
    events = store.events.where(F.col("at_ms") >= since).select("rid", "at_ms", "actor", "actor_name", "is_bulk")
    of_type = F.col("type") == "symbol" if symbols else F.col("type") != "symbol"
    known = store.entities.where(of_type)
    return store.touches.select("rid", "entity").join(known, "entity").join(events, "rid")


def _limited(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(limit) if limit else df


def hotspots(store: Store, since: int = 0, symbols: bool = False, limit: int | None = 25) -> DataFrame:
    """``entity``, ``changes``, ``size``, ``score``: changes times size, as a share of the largest listed."""
    rows = _touches(store, since, symbols).where("NOT deleted AND NOT excluded")
    raw = rows.groupBy("entity", "size").agg(F.count("*").alias("changes")).withColumn("raw", F.col("changes") * F.greatest("size", F.lit(1)))
    best = _limited(raw, limit, F.desc("raw"), F.col("entity"))
    return best.join(F.broadcast(raw.agg(F.max("raw").alias("most"))), F.lit(True)).select("entity", "changes", "size", (F.col("raw") / F.col("most")).alias("score"))


def churn(store: Store, since: int = 0, symbols: bool = False, limit: int | None = 25) -> DataFrame:
    """``entity``, ``added``, ``deleted``: lines, without those of binary changes (negative counts)."""
    lines = store.touches.select("rid", "entity", F.greatest("added", F.lit(0)).alias("a"), F.greatest("deleted", F.lit(0)).alias("d"))
    known = store.entities.where((F.col("type") == "symbol") if symbols else (F.col("type") != "symbol")).where("NOT excluded").select("entity")
    events = store.events.where(F.col("at_ms") >= since).select("rid")
    out = lines.join(known, "entity").join(events, "rid").groupBy("entity").agg(F.sum("a").alias("added"), F.sum("d").alias("deleted"))
    return _limited(out, limit, F.desc(F.col("added") + F.col("deleted")), F.col("entity"))


def coupling(store: Store, entity: str, least: int = 2, limit: int | None = 25) -> DataFrame:
    """``entity``, ``support``, ``confidence``: what changes together with ``entity``, bulk events aside."""
    changes = store.touches.join(store.events.where("NOT is_bulk").select("rid"), "rid", "left_semi").select("rid", "entity")
    mine = changes.where(F.col("entity") == entity).select("rid")
    together = changes.join(mine, "rid", "left_semi").where(F.col("entity") != entity).groupBy("entity").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    out = together.join(F.broadcast(mine.agg(F.count("*").alias("total"))), F.lit(True))  # one row
    return _limited(out.select("entity", "support", (F.col("support") / F.col("total")).alias("confidence")), limit, F.desc("support"), F.col("entity"))


def coupling_pairs(store: Store, least: int = 2) -> DataFrame:
    """``a``, ``b``, ``support``: all pairs (a before b) that change together at least ``least`` times.

    Bulk events, the only ones with many entities, are left out, so an event makes few pairs.
    """
    changes = store.touches.join(store.events.where("NOT is_bulk").select("rid"), "rid", "left_semi")
    sets = changes.groupBy("rid").agg(F.array_sort(F.collect_set("entity")).alias("e")).where("size(e) > 1")
    pairs = sets.select(F.explode(F.expr("flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> struct(x AS a, y AS b))))")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def owners(store: Store, prefix: str = "") -> DataFrame:
    """``actor``, ``changes``, ``share``, ``bus_factor`` of entities that start with ``prefix``.

    The bus factor is the number of actors, from the busiest down, of whom the ones before have less
    than half of all changes. Events without an actor don't count.
    """
    rows = store.touches.where(F.col("entity").startswith(prefix)).select("rid").join(store.events.where("actor IS NOT NULL").select("rid", "actor"), "rid")
    counts = rows.groupBy("actor").agg(F.count("*").alias("changes"))
    total = counts.agg(F.sum("changes").alias("total"))
    place = Window.orderBy(F.desc("changes"), "actor")  # one row for each actor
    ranked = counts.join(F.broadcast(total), F.lit(True)).withColumn("before", F.sum("changes").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    core = F.coalesce("before", F.lit(0)) < F.floor((F.col("total") + 1) / 2)
    factor = ranked.where(core).agg(F.count("*").alias("bus_factor"))
    out = ranked.join(F.broadcast(factor), F.lit(True)).select("actor", "changes", (F.col("changes") / F.col("total")).alias("share"), "bus_factor")
    return out.orderBy(F.desc("changes"), "actor")


def _fixes(store: Store) -> DataFrame:
    fixed = store.labels.where("task = 'is_fix' AND label = 'true'").select("rid")
    return store.events.where("NOT is_bulk").join(fixed, "rid", "left_semi")


def bug_areas(store: Store, since: int = 0, recent: int = RECENT, limit: int | None = 15) -> DataFrame:
    """``dir``, ``fixes``, ``recent``: fixes by the first two segments of what they touch, each once."""
    rows = _fixes(store).where(F.col("at_ms") >= since).select("rid", "at_ms").join(store.touches.select("rid", "entity"), "rid")
    newest = store.events.agg(F.max("at_ms").alias("newest"))
    late = rows.join(F.broadcast(newest), F.lit(True)).select("rid", top_dir(F.col("entity")).alias("dir"), (F.col("at_ms") >= F.col("newest") - recent).alias("late"))
    out = late.groupBy("dir").agg(F.count_distinct("rid").alias("fixes"), F.count_distinct(F.when(F.col("late"), F.col("rid"))).alias("recent"))
    return _limited(out, limit, F.desc(F.col("fixes") + F.col("recent")), F.col("dir"))


def bug_categories(store: Store, files: int = 3, examples: int = 2) -> DataFrame:
    """``category``, ``fixes``, its ``files`` most fixed entities, and ``examples`` ids, latest first."""
    rows = _fixes(store).select("rid", "id", "at_ms").join(store.labels.where("task = 'bug_category'").select("rid", F.col("label").alias("category")), "rid")
    counts = rows.groupBy("category").agg(F.count("*").alias("fixes"))
    hit = rows.select("rid", "category").join(store.touches.select("rid", "entity"), "rid").groupBy("category", "entity").agg(F.count("*").alias("n"))
    by_count = Window.partitionBy("category").orderBy(F.desc("n"), "entity")
    best = hit.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= files)
    best = best.groupBy("category").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", "entity"))), lambda x: x["entity"])).alias("files"))
    by_time = Window.partitionBy("category").orderBy(F.desc("at_ms"), "id")
    some = rows.withColumn("place", F.row_number().over(by_time)).where(F.col("place") <= examples)
    some = some.groupBy("category").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])).alias("examples"))
    return counts.join(best, "category", "left").join(some, "category", "left").select("category", "fixes", "files", "examples")


def ticket(store: Store, name: str, rel: str = "ticket") -> DataFrame:
    """Events that link to a ticket, in the order of time."""
    named = store.links.where((F.col("rel") == rel) & (F.col("target") == name)).select("rid")
    return store.events.join(named, "rid", "left_semi").select("id", "at_ms", "actor", "title").orderBy("at_ms", "id")


def ticket_files(store: Store, name: str, rel: str = "ticket", limit: int = 50) -> DataFrame:
    """Entities that those events touch, by name."""
    named = store.links.where((F.col("rel") == rel) & (F.col("target") == name)).select("rid")
    return store.touches.join(named, "rid", "left_semi").select("entity").distinct().orderBy("entity").limit(limit)


def ticket_prs(store: Store, name: str) -> DataFrame:
    """Pull requests that cite a ticket in their title or labels."""
    cites = F.lower("title").contains(name.lower()) | F.lower("labels").contains(name.lower())
    return store.issues.where((F.col("kind") == "pr") & cites).select("number", "title", "state", "merged").orderBy(F.desc("number"))


def prs(store: Store, limit: int = 30) -> DataFrame:
    """Pull requests, latest number first."""
    return store.issues.where("kind = 'pr'").select("number", "title", "state", "merged", "closed_at").orderBy(F.desc("number")).limit(limit)


def phases(store: Store) -> DataFrame:
    """Tags in the order of time."""
    return store.markers.where("kind = 'tag'").select("name", "at_ms", "ref").orderBy("at_ms", "name")


def explain(store: Store, blame: DataFrame, entity: str, limit: int = 15) -> DataFrame:
    """What is known of the commits that ``blame`` (``sha``, ``author``, ``author_ms``, ``lines``) names.

    ``fix`` is yes or maybe by the confidence of the label, no, or - for a commit that isn't indexed.
    """
    labels = store.labels.where("task = 'is_fix'").select("rid", "label", "confidence")
    known = store.events.select("rid", F.col("id").alias("sha"), "title").join(labels, "rid", "left")
    lines = blame.groupBy("sha", "author", "author_ms").agg(F.sum("lines").alias("lines"))
    fix = F.when(F.col("rid").isNull(), "-").when(F.col("label") == "true", F.when(F.col("confidence") >= 1, "yes").otherwise("maybe")).otherwise("no")
    return lines.join(known, "sha", "left").select("sha", "author", "author_ms", "lines", "title", fix.alias("fix")).orderBy(F.desc("author_ms"), "sha").limit(limit)


def co_changes(store: Store, entity: str, limit: int = 8, symbols: int = 3) -> DataFrame:
    """Entities that change with ``entity`` at least twice, each with its most changed symbols."""
    mine = store.touches.where(F.col("entity") == entity).select("rid")
    with_it = store.touches.join(mine, "rid", "left_semi").where(F.col("entity") != entity)
    file = F.split_part("entity", F.lit("#"), F.lit(1))
    best = with_it.where(~F.col("entity").contains("#")).groupBy("entity").agg(F.count_distinct("rid").alias("commits")).where("commits >= 2").orderBy(F.desc("commits"), "entity").limit(limit)
    names = with_it.where(F.col("entity").contains("#")).groupBy(file.alias("entity"), F.col("entity").alias("symbol")).agg(F.count("*").alias("n"))
    place = Window.partitionBy("entity").orderBy(F.desc("n"), "symbol")
    some = names.withColumn("place", F.row_number().over(place)).where(F.col("place") <= symbols).groupBy("entity").agg(F.concat_ws(",", F.array_sort(F.collect_list("symbol"))).alias("symbols"))
    return best.join(some, "entity", "left").select("entity", "commits", F.coalesce("symbols", F.lit("")).alias("symbols"))


def branches(revs: DataFrame, stale: int = RECENT) -> DataFrame:
    """State of branches from landed rows ``branch``, ``side`` (ahead, behind), ``sha``, ``author``, ``at_ms``.

    A branch is merged if nothing is ahead, and stale if its last commit is ``stale`` ms older than
    the newest of all. Its bus factor is the least number of authors with over half of its commits.
    """
    own = revs.where("side = 'ahead'")
    counts = own.groupBy("branch", "author").agg(F.count("*").alias("n"))
    total = counts.groupBy("branch").agg(F.sum("n").alias("ahead"), F.count("*").alias("authors"))
    order = Window.partitionBy("branch").orderBy(F.desc("n"), "author")
    running = counts.join(total, "branch").withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order))
    factor = running.where("upto * 2 > ahead").groupBy("branch").agg(F.min("k").alias("bus_factor"))
    last = revs.groupBy("branch").agg(F.max("at_ms").alias("last_ms"), F.count(F.when(F.col("side") == "behind", 1)).alias("behind"))
    newest = revs.agg(F.max("at_ms").alias("newest"))
    out = last.join(total, "branch", "left").join(factor, "branch", "left").join(F.broadcast(newest), F.lit(True))
    ahead = F.coalesce("ahead", F.lit(0))
    return out.select("branch", ahead.alias("ahead"), "behind", (ahead == 0).alias("merged"), (F.col("newest") - F.col("last_ms") >= stale).alias("stale"), F.coalesce("authors", F.lit(0)).alias("authors"), F.coalesce("bus_factor", F.lit(0)).alias("bus_factor"))
