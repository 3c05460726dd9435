"""Ingest: from normalised records to the tables of an event history.

A record is a row with the columns of ``RECORD``. The steps keep their order: body cap, id salt,
relations, secrets, entity by relation, dedupe by id, labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.patterns import excluded, java_regex
from .model import Store, as_events

RECORD = """id STRING, source STRING, kind STRING, at_ms LONG, actor STRING, actor_name STRING, title STRING, body STRING,
    level STRING, attrs MAP<STRING, STRING>, touches ARRAY<STRUCT<entity: STRING, type: STRING, weight: LONG, added: LONG, deleted: LONG>>,
    links ARRAY<STRUCT<rel: STRING, target: STRING>>, place LONG"""

# Words in a message that make it a fix, those of each category of bug, labels of a
# forge that make an issue a bug, and paths that are left out of code metrics.
FIX_WORDS = ("fix", "bug", "hotfix", "patch", "fixes", "fixed", "broken", "arregl", "corrig", "solucion", "repara", "error", "falla", "roto")
CATEGORIES = {
    "memory-safety": ("memory leak", "leak", "use-after-free", "double-free", "segfault", "oom", "out of memory", "uninitialized", "buffer overflow"),
    "crash": ("crash", "panic", "abort", "assertion", "sigsegv", "sigabrt", "fatal"),
    "concurrency": ("race condition", "data race", "deadlock", "mutex", "thread safety", "atomic"),
    "network": ("tls", "ssl", "socket", "websocket", "http/2", "http2", "tcp", "keep-alive", "handshake", "timeout", "fetch"),
    "install-deps": ("lockfile", "bun.lock", "dependency", "dependencies", "registry", "workspace", "node_modules", "npm install"),
    "types": ("typescript", "d.ts", "tsconfig", "type definition", "typings"),
    "parser": ("parser", "lexer", "transpiler", "syntax error", "tokenizer", "ast "),
    "performance": ("performance", "regression", "memory usage", "cpu usage", "slow"),
    "security": ("security", "vulnerability", "cve", "injection", "sanitize"),
    "data-db": ("sqlite", "postgres", "mysql", "serialize", "deserialize", "encoding", "sql query"),
    "windows": ("windows", "win32"),
    "build": ("bundler", "compile error", "linker", "codegen", "cross-compile"),
}
BUG_LABELS = ("bug", "defect", "regression", "error", "fix", "hotfix")
EXCLUDED = ("*-lock.json", "*.lock", "package-lock.json", "*.min.js", "*.csv", "dist/*", "build/*", "vendor/*", "node_modules/*")


@dataclass(frozen=True)
class Relation:
    """Links of a relation taken from a field: title, id, kind, level, actor, entity, link:<rel> or an attribute."""

    name: str
    field: str
    source: str = ""
    pattern: str = ""
    length: int = 0


@dataclass(frozen=True)
class Options:
    """What ingest may be told; by default nothing is cut, declared or related."""

    body_most: int = 0
    dims: tuple[str, ...] = ()
    relations: tuple[Relation, ...] = ()
    entity_via: str = ""
    redact: bool = True
    fix_words: tuple[str, ...] = FIX_WORDS
    categories: dict[str, tuple[str, ...]] = field(default_factory=lambda: CATEGORIES)
    exempt: tuple[str, ...] = ("git", "nod", "oslog")
    excluded: tuple[str, ...] = EXCLUDED


def _field(name: str) -> Column:
    """Values of a field, as an array."""
    if name.startswith("link:"):
        rel = name[5:]
        return F.transform(F.filter("links", lambda x: x["rel"] == rel), lambda x: x["target"])
    if name == "entity":
        return F.transform("touches", lambda x: x["entity"])
    if name in ("title", "id", "kind", "level", "actor"):
        return F.array(F.col(name))
    return F.array(F.col("attrs")[name])


def relate(records: DataFrame, relations: tuple[Relation, ...]) -> DataFrame:
    """``records`` with the links that ``relations`` find, each once."""
    for r in relations:
        values = _field(r.field)
        if r.pattern:
            pattern = java_regex(r.pattern)
            group = 1 if re.search(r"(?<!\\)\(", r.pattern) else 0
            values = F.flatten(_extracted(values, pattern, group))
        if r.length:
            values = _cut(values, r.length)
        found = _named(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), r.name)
        applies = F.split_part("source", F.lit(":"), F.lit(1)) == r.source if r.source else F.lit(True)
        records = records.withColumn("links", F.when(applies, F.array_union("links", found)).otherwise(F.col("links")))
    return records


def _extracted(values: Column, pattern: str, group: int) -> Column:
    return F.transform(values, lambda x: F.coalesce(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")))


def _cut(values: Column, length: int) -> Column:
    return F.transform(values, lambda x: F.left(x, F.lit(length)))


def _named(values: Column, rel: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(rel).alias("rel"), x.alias("target")))


def salted(records: DataFrame, exempt: tuple[str, ...]) -> DataFrame:
    """Ids that are hashes get a prefix of their source and file, so equal lines of two sources differ."""
    where = F.concat_ws("\n", "source", F.col("attrs")["file"])
    prefix = F.substring(F.sha2(where, 256), 1, 8)
    plain = F.col("id").contains(":") | F.split_part("source", F.lit(":"), F.lit(1)).isin(*exempt)
    return records.withColumn("id", F.when(plain, F.col("id")).otherwise(F.concat_ws(".", prefix, "id")))


def without_secrets(records: DataFrame) -> DataFrame:
    """Title, body, link targets and attribute values without secrets; whole values of sensitive keys go."""
    names = "|".join(re.escape(x) for x in T.SENSITIVE)

    @F.pandas_udf("map<string,string>")
    def clean(maps):  # noqa: ANN001, ANN202
        return maps.map(lambda m: m if m is None else {k: T.SECRET if T.sensitive(k) and v else T.redacted(v)[0] for k, v in dict(m).items()})

    risky = F.exists(F.map_entries("attrs"), lambda e: F.lower(e["key"]).rlike(names) | F.lower(e["value"]).rlike(names + "|eyj|://|akia|bearer|basic|begin|gh[a-z]_|xox|sk-"))
    return records.withColumn("title", T.redact(F.col("title"))).withColumn("body", T.redact(F.col("body"))).withColumn("attrs", F.coalesce(clean(F.when(risky, F.col("attrs"))), F.col("attrs")))


def via(records: DataFrame, rel: str) -> DataFrame:
    """An event whose only entity is ``unknown`` takes that of the first event with a link of ``rel`` in common."""
    known = records.select("rid", F.explode("links").alias("l"), F.col("touches")[0]["entity"].alias("e")).where((F.col("l.rel") == rel))
    first = known.where("e IS NOT NULL AND e <> 'unknown'").groupBy(F.col("l.target").alias("target")).agg(F.min(F.struct("rid", "e")).alias("best"))
    lost = known.where("e = 'unknown'").select("rid", F.col("l.target").alias("target")).join(first, "target").groupBy("rid").agg(F.min("best").alias("best"))
    found = records.join(lost.select("rid", F.col("best.e").alias("__e")), "rid", "left")
    renamed = F.transform("touches", lambda t: t.withField("entity", F.when(t["entity"] == "unknown", F.coalesce("__e", t["entity"])).otherwise(t["entity"])))
    return found.withColumn("touches", F.when(F.col("__e").isNotNull() & (F.size("touches") == 1), renamed).otherwise(F.col("touches"))).drop("__e")


def numbered(records: DataFrame, base: int = 0) -> DataFrame:
    """``records`` with ``rid``: places in the order of insertion, from ``base`` + 1, and the first of equal ids only.

    Rids follow the order of (time of reading, place) by range partitions and per-partition counts, so
    no single task sees all rows.
    """
    first = Window.partitionBy("id").orderBy("place")
    once = records.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = once.repartitionByRange(parts, "place", "id").sortWithinPartitions("place", "id").withColumn("__m", F.monotonically_increasing_id())
    return dealt.withColumn("rid", F.col("__m") + base + 1).drop("__m")


def labels_of(events: DataFrame, options: Options) -> DataFrame:
    """Labels of commits by rules: kind, is_fix, bug_category. One label of a task for each event."""
    low = F.lower(F.concat_ws("\n", F.col("title"), T.clean_body(F.col("body"))))
    has = lambda ws: reduce(lambda a, b: a | b, [low.contains(w) for w in ws], F.lit(False))
    kind = T.conventional_kind(F.col("title"))
    sure = (kind == "fix") | (T.reverted(F.col("body")) != "")
    maybe = has(options.fix_words)
    fix = F.struct(F.lit("is_fix").alias("task"), F.when(sure | maybe, "true").otherwise("false").alias("label"), F.when(sure | ~maybe, 1.0).otherwise(0.8).alias("confidence"))
    category = F.lit("")
    for name in sorted(options.categories, reverse=True):  # the first by name wins
        category = F.when(has(options.categories[name]), name).otherwise(category)
    tasks = F.array(
        F.struct(F.lit("kind").alias("task"), kind.alias("label"), F.lit(1.0).alias("confidence")),
        fix,
        F.struct(F.lit("bug_category").alias("task"), category.alias("label"), F.lit(0.7).alias("confidence")),
    )
    rows = events.where("kind = 'commit'").select("rid", F.explode(F.filter(tasks, lambda x: x["label"] != "")).alias("x"))
    return rows.select("rid", "x.task", "x.label", "x.confidence", F.lit("rules").alias("src"), F.lit("").alias("evidence"))


def chained(*stages: DataFrame) -> DataFrame:
    """Labels of several classifiers: for each event and task, what the first of them says that says anything."""
    named = [s.withColumn("stage", F.lit(k)) for k, s in enumerate(stages)]
    rows = reduce(DataFrame.unionByName, named)
    first = rows.groupBy("rid", "task").agg(F.min(F.struct("stage", "label", "confidence", "src", "evidence")).alias("x"))
    return first.select("rid", "task", "x.label", "x.confidence", "x.src", "x.evidence")


def ingest(records: DataFrame, options: Options = Options(), base: int = 0) -> Store:
    """The tables of the history that ``records`` make."""
    rows = records
    if options.body_most:
        rows = rows.withColumn("body", F.left("body", F.lit(options.body_most)))
    rows = salted(rows, options.exempt)
    rows = relate(rows, options.relations)
    if options.redact:
        rows = without_secrets(rows)
    rows = numbered(rows, base)
    if options.entity_via:
        rows = via(rows, options.entity_via)
    declared = F.array(*(F.lit(x) for x in options.dims)).cast("array<string>")
    inferred = F.when((F.col("level") == "") & (F.col("kind") != "commit"), T.inferred_level(F.col("title"))).otherwise(F.col("level"))
    rows = rows.withColumn("dims", F.map_filter("attrs", lambda k, v: F.array_contains(declared, k))).withColumn("attrs", F.map_filter("attrs", lambda k, v: ~F.array_contains(declared, k)))
    rows = rows.withColumn("level_inf", inferred).withColumn("template", T.templatize(F.col("title"))).withColumn("touches_n", F.size("touches")).withColumn("is_bulk", F.size("touches") > 50)
    rows = rows.withColumn("simhash", T.simhash(F.when(F.col("kind") == "commit", F.concat_ws("\n", "title", "body"))).cast("long"))
    touched = rows.select("rid", F.explode("touches").alias("t"))
    touches = touched.groupBy("rid", F.col("t.entity").alias("entity")).agg(F.sum("t.weight").alias("weight"), F.sum("t.added").alias("added"), F.sum("t.deleted").alias("deleted")).withColumn("attrs", F.create_map().cast("map<string,string>"))
    entities = touched.groupBy(F.col("t.entity").alias("entity")).agg(F.min("t.type").alias("type")).select("entity", "type", F.lit(0).cast("long").alias("size"), F.lit(False).alias("deleted"), excluded(F.col("entity"), options.excluded).alias("excluded"))
    links = rows.select("rid", F.explode("links").alias("l")).select("rid", "l.rel", "l.target").distinct()
    events = as_events(rows)
    return Store.of(events, touches=touches, entities=entities, links=links, labels=labels_of(events, options))
