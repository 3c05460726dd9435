"""Sources outside Spark: commands that print JSON, and what the driver lands for version control."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ingest import BUG_LABELS


def extracted(text: str, records: str = "") -> list[dict]:
    """Records in a command's output: a list, an object, the list at a dotted path, or JSON lines."""
    try:
        value = json.loads(text)
    except ValueError:
        return [x for x in (json.loads(line) for line in text.splitlines() if line.strip()) if isinstance(x, dict)]
    for part in filter(None, records.split(".")):
        value = value.get(part) if isinstance(value, dict) else None
    items = value if isinstance(value, list) else [value]
    return [x for x in items if isinstance(x, dict)]


def run(argv: list[str], timeout: float = 60, cwd: str | None = None) -> str:
    """Output of a command that is run without a shell; an error if it fails or takes too long."""
    done = subprocess.run(argv, capture_output=True, text=True, timeout=timeout, cwd=cwd, check=False)
    if done.returncode:
        raise RuntimeError(f"{argv[0]} ended with {done.returncode}: {done.stderr[-400:]}")
    return done.stdout


def land(items: Iterable[dict], path: str, key: str = "") -> int:
    """Append those of ``items`` whose key a JSON-lines file doesn't have yet; how many there were."""
    file = Path(path)
    name = lambda x: json.dumps(x.get(key) if key else x, sort_keys=True)
    known = {name(json.loads(line)) for line in file.read_text().splitlines()} if file.exists() else set()
    new = {name(x): x for x in items}
    fresh = [x for k, x in new.items() if k not in known]
    with file.open("a") as out:
        out.writelines(json.dumps(x, sort_keys=True) + "\n" for x in fresh)
    return len(fresh)


#: The fields of a landed commit, parted by 0x1f; commits start with 0x1e.
GIT_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%cI%x1f%s%x1f%b%x1f"


def land_git(repo: str, path: str, rev: str = "HEAD") -> None:
    """Write a repository's history to a file that ``commits`` reads."""
    Path(path).write_text(run(["git", "-C", repo, "log", "--no-merges", "--use-mailmap", "--numstat", "-M", f"--format={GIT_FORMAT}", rev], timeout=600))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``line``, ``file``, ``place``: one landed commit each."""
    rows = spark.read.option("lineSep", "\x1e").text(path)
    return rows.select(F.regexp_replace("value", "\n+$", "").alias("line"), F.col("_metadata.file_name").alias("file")).withColumn("place", F.monotonically_increasing_id()).where("line <> ''")


def issues(landed: DataFrame, kind: str, bug_labels: tuple[str, ...] = BUG_LABELS) -> DataFrame:
    """Issues or pull requests from landed JSON lines of a forge; of a number that repeats, the last line."""
    schema = "number LONG, title STRING, state STRING, mergedAt STRING, closedAt STRING, labels ARRAY<STRUCT<name: STRING>>"
    x = landed.withColumn("x", F.from_json("line", schema)).where("x.number IS NOT NULL")
    names = F.transform(F.coalesce("x.labels", F.array().cast("array<struct<name:string>>")), lambda y: y["name"])
    rows = x.select(
        F.col("x.number").alias("number"), F.lit(kind).alias("kind"), F.col("x.title").alias("title"), F.lower("x.state").alias("state"), F.array_join(names, ",").alias("labels"),
        F.col("x.mergedAt").isNotNull().alias("merged"), F.unix_millis(F.try_to_timestamp(F.coalesce("x.mergedAt", "x.closedAt"))).alias("closed_at"),
        F.arrays_overlap(names, F.array(*(F.lit(b) for b in bug_labels))).alias("is_bug"), "place",
    )
    return rows.groupBy("number", "kind").agg(F.max_by(F.struct("title", "state", "labels", "merged", "closed_at", "is_bug"), "place").alias("r")).select("number", "kind", "r.*")


#: The fields of a landed tag, parted by 0x1f.
TAG_FORMAT = "%(refname:short)%1f%(creatordate:short)%1f%(objectname:short)"


def land_tree(repo: str, path: str) -> None:
    """Write a repository's tags and the files of its head, with their lines, to a folder that ``tags`` and ``sized`` read."""
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    folder.joinpath("tags.txt").write_text(run(["git", "-C", repo, "for-each-ref", "--sort=creatordate", f"--format={TAG_FORMAT}", "refs/tags"]))
    # the changes from the empty tree list each file of the head once, with all its lines
    empty = run(["git", "-C", repo, "hash-object", "-t", "tree", "/dev/null"]).strip()
    folder.joinpath("tree.txt").write_text(run(["git", "-C", repo, "-c", "core.quotePath=false", "diff", "--numstat", "--no-renames", empty, "HEAD"], timeout=600))


def tags(landed: DataFrame, source: str = "git") -> DataFrame:
    """Markers (``source``, ``name``, ``at_ms``, ``ref``, ``kind``) from landed tags; of a name that repeats, the last line."""
    part = lambda k: F.coalesce(F.get(F.split("line", "\x1f"), k), F.lit(""))
    at = F.coalesce(F.unix_millis(F.try_to_timestamp(part(1))), F.lit(0)).alias("at_ms")
    rows = landed.select("place", part(0).alias("name"), at, part(2).alias("ref")).where("name <> ''")
    last = rows.groupBy("name").agg(F.max_by(F.struct("at_ms", "ref"), "place").alias("r"))
    return last.select(F.lit(source).alias("source"), "name", "r.at_ms", "r.ref", F.lit("tag").alias("kind"))


def sized(entities: DataFrame, landed: DataFrame) -> DataFrame:
    """``entities`` with the ``size`` of each file of the landed tree, and ``deleted`` for files that it lacks.

    A binary file has size 0. Entities of other types stay as they are. The tree has every file, so
    sizes aren't limited to those that change most.
    """
    part = F.split("line", "\t", 3)
    tree = landed.where(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.")).select(part[2].alias("entity"), F.coalesce(F.expr("try_cast(split(line, '\t')[0] AS LONG)"), F.lit(0)).alias("__lines"))
    tree = tree.groupBy("entity").agg(F.max("__lines").alias("__lines"))
    file, known = F.col("type") == "file", F.col("__lines").isNotNull()
    out = entities.join(tree, "entity", "left")
    return out.select("entity", "type", F.when(file & known, F.col("__lines")).otherwise(F.col("size")).alias("size"), F.when(file, ~known).otherwise(F.col("deleted")).alias("deleted"), "excluded")
