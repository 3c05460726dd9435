"""JSON lines: fields found line by line, lines that hold several events, selectors into nested values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import epoch_ms, parsed_ms
from .lines import line_id, records, touch

# Names that a field may have, in the order in which they are tried.
TIME = ("ts", "time", "timestamp", "@timestamp", "date", "eventTime")
MESSAGE = ("msg", "message", "text", "log", "event")
LEVEL = ("level", "severity", "lvl", "loglevel")
ENTITY = ("service", "logger", "name", "path", "source", "unit", "container", "component")
ACTOR = ("host", "hostname", "service", "pod", "node")
#: Attributes that are kept when none are named.
MOST = 30


@dataclass(frozen=True)
class Fields:
    """Selectors; where one is empty, the usual names are tried on every line.

    ``where`` are conditions ``name=a|b`` on the line, ``explode_where`` on each element of the list at
    ``explode``. ``uid`` and ``error_message`` may name alternatives, ``a|b``.
    """

    time: str = ""
    message: str = ""
    level: str = ""
    entity: str = ""
    actor: str = ""
    id: str = ""
    uid: str = ""
    kind: str = ""
    where: tuple[str, ...] = ()
    explode: str = ""
    explode_where: tuple[str, ...] = ()
    error_message: str = ""
    attrs: tuple[str, ...] = ()
    links: tuple[tuple[str, str], ...] = ()
    level_map: dict[str, str] = field(default_factory=dict)
    entity_join: str = ""


#: Transcripts of coding agents: one event for each use of a tool and each result.
TRANSCRIPTS = Fields(
    time="timestamp", message="name", level="is_error", entity="name", kind="type", uid="id|tool_use_id", where=("type=assistant|user",), explode="message.content",
    explode_where=("type=tool_use|tool_result",), error_message="content|content.0.text", level_map={"true": "ERROR", "false": ""},
    links=(("tool_use", "id"), ("tool_use", "tool_use_id"), ("file", "input.file_path"), ("url", "input.url")), attrs=("cwd", "gitBranch", "sessionId", "isSidechain", "version"),
)


def path_of(selector: str) -> str:
    """A selector as a JSON path: ``a.b``, ``a.0``, ``a[0]``."""
    out = "$"
    for part in re.findall(r"[^.\[\]]+|\[\d*\]", selector):
        out += "[0]" if part == "[]" else part if part.startswith("[") else f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def select(value: Column, selector: str) -> Column:
    """The text at ``selector``: the literal key first, the path second; null unless text, number or boolean.

    ``a[].b`` is ``b`` of the first element of ``a`` that has it.
    """
    literal = F.try_variant_get(value, f"$['{selector}']", "string") if "'" not in selector else F.lit(None)
    if "[]." in selector:
        head, _, rest = selector.partition("[].")
        items = F.try_variant_get(value, path_of(head), "array<variant>")
        found = F.filter(F.transform(items, lambda x: F.try_variant_get(x, path_of(rest), "string")), lambda x: x.isNotNull())
        return F.coalesce(literal, F.get(found, 0))
    # an object or a list isn't a value
    text = F.try_variant_get(value, path_of(selector), "string")
    scalar = F.when(~F.coalesce(text, F.lit("")).rlike(r"^\s*[\[{]"), text)
    return F.coalesce(literal, scalar)


def _first(value: Column, root: Column, given: str, usual: tuple[str, ...]) -> Column:
    """A field of the element, else of the line that it came from."""
    names = (given,) if given else usual
    return F.coalesce(*(select(value, n) for n in names), *(select(root, n) for n in names))


def _kind(item: Column, fields: Fields, kind: str) -> Column:
    return F.coalesce(select(item, fields.kind), F.lit(kind)) if fields.kind else F.lit(kind)


def parse(lines: DataFrame, fields: Fields = Fields(), source: str = "jsonl", kind: str = "log") -> DataFrame:
    """Records of JSON lines (``line``, ``file``, ``place``); lines that aren't objects are left out."""
    rows = lines.withColumn("root", F.try_parse_json("line")).where(F.schema_of_variant("root").startswith("OBJECT"))
    for condition in fields.where:
        name, _, wanted = condition.partition("=")
        rows = rows.where(select(F.col("root"), name).isin(wanted.split("|")))
    if fields.explode:
        items = F.try_variant_get("root", path_of(fields.explode), "array<variant>")
        rows = rows.select("*", F.posexplode(items).alias("nth", "item"))
        ident = line_id(F.col("line"), F.col("nth"))
    else:
        rows = rows.withColumn("item", F.col("root"))
        ident = line_id(F.col("line"), F.col("file"), F.col("place"))
    item, root = F.col("item"), F.col("root")
    for condition in fields.explode_where:
        name, _, wanted = condition.partition("=")
        rows = rows.where(select(item, name).isin(wanted.split("|")))
    told = F.coalesce(*(select(item, n) for n in ((fields.id,) if fields.id else ("id", "_id", "uuid"))))
    if fields.id:
        told = F.concat_ws(":", "file", told)
    if fields.uid:
        told = F.concat(_kind(item, fields, kind), F.lit(":"), _first(item, root, "", tuple(fields.uid.split("|"))))
    level = F.upper(_first(item, root, fields.level, LEVEL))
    for k, v in fields.level_map.items():
        level = F.when(level == k.upper(), v.upper()).otherwise(level)
    entity = _first(item, root, fields.entity, ENTITY)
    if fields.entity_join:
        # the last entity that a line of the same file and key named
        rows = rows.withColumn("__key", _first(item, root, fields.entity_join, ()))
        before = Window.partitionBy("file", "__key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        entity = F.coalesce(entity, F.when(F.col("__key").isNotNull(), F.last(entity, ignorenulls=True).over(before)))
    if fields.attrs:
        attrs = F.map_from_arrays(F.array(*(F.lit(a) for a in fields.attrs)), F.array(*(F.coalesce(select(item, a), select(root, a)) for a in fields.attrs)))
    else:
        flat = F.from_json(F.to_json(item), "map<string,string>")
        scalars = F.map_filter(flat, lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
        attrs = F.map_from_entries(F.slice(F.array_sort(F.map_entries(scalars)), 1, MOST))
    attrs = F.map_filter(attrs, lambda k, v: v.isNotNull())
    links = F.array(*(F.struct(F.lit(rel).alias("rel"), F.coalesce(select(item, s), select(root, s)).alias("target")) for rel, s in fields.links))
    stamp = _first(item, root, fields.time, TIME)
    number = stamp.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+]?[0-9]+)?$")
    at = F.when(number, epoch_ms(F.expr("1").cast("double") * stamp.try_cast("double"))).otherwise(parsed_ms(stamp))
    message = _first(item, root, fields.message, MESSAGE)
    if fields.error_message:
        message = F.when(level == "ERROR", F.coalesce(_first(item, root, "", tuple(fields.error_message.split("|"))), message)).otherwise(message)
    names = F.array_join(F.slice(F.array_sort(F.map_keys(F.from_json(F.to_json(item), "map<string,string>"))), 1, 8), ",")
    text = F.coalesce(message, F.concat(F.lit("{"), names, F.lit("}")))
    head = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return records(
        rows, source,
        id=F.coalesce(told, ident), kind=_kind(item, fields, kind),
        at_ms=at, actor=_first(item, root, fields.actor, ACTOR), title=F.left(F.coalesce(F.get(head, 0), F.lit("")), F.lit(500)),
        body=F.when(F.size(head) > 1, text).otherwise(""), level=F.coalesce(level, F.lit("")), attrs=attrs,
        touches=touch(F.coalesce(entity, F.lit("unknown")), "log-source"),
        links=F.filter(links, lambda x: x["target"].isNotNull()) if fields.links else F.array(),
        place=F.col("place"),
    )
