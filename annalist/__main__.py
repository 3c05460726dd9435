"""Command line: ``python -m annalist VERB FOLDER [options]`` over the Parquet tables of a history."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .functions.times import duration_ms, instant_ms
from .model import ENTITIES, EVENTS, ISSUES, LABELS, LINKS, MARKERS, TOUCHES, Store, empty
from .operators import code, counting, episodes, relations, reports, search
from .operators.scope import Scope
from .plans import envelope


def opened(spark: SparkSession, path: str) -> Store:
    """The history under ``path``; tables that aren't there are empty."""
    schemas = {"events": EVENTS, "touches": TOUCHES, "entities": ENTITIES, "links": LINKS, "labels": LABELS, "markers": MARKERS, "issues": ISSUES}

    def table(name: str) -> DataFrame:
        try:
            return spark.read.schema(schemas[name]).parquet(f"{path.rstrip('/')}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return empty(spark, schemas[name])

    return Store(**{n: table(n) for n in schemas})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="annalist", description=__doc__)
    p.add_argument("verb", choices=sorted(VERBS))
    p.add_argument("folder")
    p.add_argument("subject", nargs="?", default="")
    for name in ("source", "kind", "level", "grep", "entity", "join", "by", "key", "from-kind", "to-kind"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--attr", action="append", default=[])
    p.add_argument("--since", type=instant_ms, default=0)
    p.add_argument("--until", type=instant_ms, default=0)
    for name, usual in (("bucket", "1h"), ("delta", "1h"), ("gap", "2m"), ("window", "2m")):
        p.add_argument(f"--{name}", type=duration_ms, default=duration_ms(usual))
    p.add_argument("--limit", type=int, default=25)
    p.add_argument("--depth", type=int, default=5)
    p.add_argument("--desc", action="store_true")
    p.add_argument("--any-order", action="store_true")
    p.add_argument("--infer-level", action="store_true")
    p.add_argument("--compact", action="store_true")
    return p


# each verb asks for one row more than the limit, so that the envelope can tell whether there are more
VERBS = {
    "top": lambda s, a, f: counting.top(s, a.subject or "level", f, a.limit + 1),
    "timeline": lambda s, a, f: counting.timeline(s, a.bucket, a.by, f, a.limit + 1),
    "patterns": lambda s, a, f: counting.patterns(s, f, a.limit + 1),
    "stats": lambda s, a, f: counting.stats(s, a.subject, a.by, f, a.limit + 1),
    "events": lambda s, a, f: counting.events(s, f, a.desc, a.limit + 1),
    "sources": lambda s, a, f: counting.sources(s),
    "search": lambda s, a, f: search.search(s, a.subject, a.limit + 1),
    "similar": lambda s, a, f: search.similar(s, a.subject, limit=a.limit + 1),
    "correlate": lambda s, a, f: relations.correlate_via(s, a.subject, a.key, a.limit + 1) if a.key else relations.correlate(s, a.subject, a.delta, a.kind, a.limit + 1),
    "gaps": lambda s, a, f: relations.gaps(s, Scope(kind=a.from_kind, since=a.since, until=a.until), Scope(kind=a.to_kind, until=a.until), a.key, a.by, a.any_order),
    "trace": lambda s, a, f: relations.trace(s, a.subject, a.depth, a.limit + 1),
    "precede": lambda s, a, f: episodes.common_precursors(s, f, a.gap, a.window, limit=a.limit + 1),
    "episodes": lambda s, a, f: episodes.episodes(s, f, a.gap, key=a.key).orderBy("start_ms", "grp"),
    "hotspots": lambda s, a, f: code.hotspots(s, a.since, a.by == "symbol", a.limit + 1),
    "churn": lambda s, a, f: code.churn(s, a.since, a.by == "symbol", a.limit + 1),
    "coupling": lambda s, a, f: code.coupling(s, a.subject, limit=a.limit + 1),
    "owners": lambda s, a, f: code.owners(s, a.subject),
    "bugs": lambda s, a, f: code.bug_areas(s, a.since, limit=a.limit + 1),
    "tickets": lambda s, a, f: code.ticket(s, a.subject),
    "prs": lambda s, a, f: code.prs(s, a.limit + 1),
    "phases": lambda s, a, f: code.phases(s),
    "report": lambda s, a, f: reports.code_report(s, a.subject) if a.subject else reports.log_report(s, f, a.gap),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    scope = Scope(a.since, a.until, a.source, a.kind, a.level, a.grep, a.entity, tuple(a.attr), a.join, a.infer_level)
    session = spark or SparkSession.builder.appName("annalist").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = envelope.answer(VERBS[a.verb](opened(session, a.folder), a, scope), f"{a.verb} {a.subject}".strip(), a.limit, since=a.since, until=a.until)
    return envelope.compact(out["result"]) if a.compact else json.dumps(out, ensure_ascii=False, default=str)


if __name__ == "__main__":
    print(main(sys.argv[1:]))
