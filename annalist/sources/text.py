"""Sources of plain lines: CSV, syslog, web access logs, user templates, changelogs, journals, version control."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reverted, tickets
from ..functions.times import parsed_ms
from .lines import line_id, records, touch

# --- separated values ----------------------------------------------------------------------------

# Names of columns, in the order in which they are tried.
_COLUMNS = {
    "time": ("ts", "time", "timestamp", "date", "@timestamp", "datetime", "occurred_at", "event_time"),
    "message": ("msg", "message", "text", "event", "description", "summary", "detail"),
    "level": ("level", "severity", "lvl", "status", "priority"),
    "entity": ("service", "endpoint", "path", "resource", "name", "component", "host", "entity", "table"),
    "actor": ("host", "user", "author", "service", "actor", "owner"),
    "id": ("id", "_id", "uuid"),
}


def csv(lines: DataFrame, header: str, delimiter: str = ",", columns: dict[str, str] | None = None, source: str = "csv") -> DataFrame:
    """Records of separated lines; one physical line is one record, and a short one lacks its last columns.

    ``header`` is the first line, which is no record. Columns are found by name once, or given.
    """
    names = [re.sub(r'^"|"$', "", x).strip() for x in header.split(delimiter)]
    low = [n.lower() for n in names]
    at = {k: (columns or {}).get(k) or next((names[low.index(c)] for c in usual if c in low), None) for k, usual in _COLUMNS.items()}
    schema = ", ".join(f"c{k} STRING" for k in range(len(names)))
    rows = lines.where(F.col("line") != header).withColumn("r", F.from_csv("line", schema, {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE"}))
    cell = {n: F.col(f"r.c{k}") for k, n in enumerate(names)}
    get = lambda k: cell[at[k]] if at[k] in cell else F.lit(None).cast("string")
    attrs = F.map_from_arrays(F.array(*(F.lit(n) for n in names[:30])), F.array(*(cell[n] for n in names[:30])))
    return records(
        rows, source, kind=F.lit("row"), id=F.coalesce(get("id"), line_id(F.col("line"), F.col("file"), F.col("place"))), at_ms=parsed_ms(get("time")), actor=get("actor"),
        title=F.coalesce(get("message"), F.left("line", F.lit(200))), level=F.upper(F.coalesce(get("level"), F.lit(""))),
        attrs=F.map_filter(attrs, lambda k, v: v.isNotNull()), touches=touch(F.coalesce(get("entity"), F.lit("unknown")), "row-source"),
    )


# --- syslog and web servers ----------------------------------------------------------------------

# Severities of the syslog protocol, by number.
SEVERITIES = ("EMERG", "ALERT", "CRIT", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG")
_NEW = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|\[.*?\]) ?(.*)$"
_OLD = r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"


def _severity(priority: Column) -> Column:
    n = F.when(priority != "", priority.cast("int") % 8)
    return F.coalesce(F.get(F.array(*(F.lit(x) for x in SEVERITIES)), n), F.lit(""))


def syslog(lines: DataFrame, year: int = 1970, source: str = "textlog") -> DataFrame:
    """Records of both syslog formats; the old one has no year."""
    new = lambda k: F.regexp_extract("line", _NEW, k)
    old = lambda k: F.regexp_extract("line", _OLD, k)
    is_new, is_old = F.col("line").rlike(_NEW), F.col("line").rlike(_OLD)
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), F.regexp_replace(old(2), "  ", " 0")), F.lit("yyyy MMM dd HH:mm:ss"))
    pick = lambda a, b: F.when(is_new, a).otherwise(b)
    app, host = F.nullif(pick(new(4), old(4)), F.lit("-")), F.nullif(pick(new(3), old(3)), F.lit("-"))
    attrs = F.map_filter(F.create_map(F.lit("host"), host, F.lit("pid"), F.nullif(pick(new(5), old(5)), F.lit("-"))), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return records(
        lines.where(is_new | is_old), source, id=line_id(F.col("line"), F.col("file"), F.col("place")),
        at_ms=pick(parsed_ms(new(2)), F.unix_millis(stamp)), title=pick(new(7), old(6)), level=_severity(pick(new(1), old(1))), attrs=attrs,
        touches=touch(F.coalesce(F.nullif(app, F.lit("")), F.nullif(host, F.lit("")), F.lit("unknown")), "log-source"),
    )


_ACCESS = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'


def access(lines: DataFrame, source: str = "textlog") -> DataFrame:
    """Records of combined or common access logs: the entity is the path, the level that of the status."""
    x = lambda k: F.regexp_extract("line", _ACCESS, k)
    status = x(6).cast("int")
    level = F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")
    attrs = F.create_map(F.lit("status"), x(6), F.lit("bytes"), x(7), F.lit("referer"), x(8), F.lit("agent"), x(9))
    return records(
        lines.where(F.col("line").rlike(_ACCESS)), source, id=line_id(F.col("line"), F.col("file"), F.col("place")), actor=x(1),
        at_ms=F.unix_millis(F.try_to_timestamp(x(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))), title=F.concat_ws(" ", x(4), x(5), x(6)), level=level,
        attrs=F.map_filter(attrs, lambda k, v: ~v.isin("", "-")), touches=touch(F.split_part(x(5), F.lit("?"), F.lit(1)), "endpoint"),
    )


# --- templates of lines --------------------------------------------------------------------------

# What a field's name says that it is.
_ROLES = {"time": ("time", "ts", "timestamp", "date"), "level": ("level", "severity"), "message": ("message", "msg"), "entity": ("svc", "service", "entity", "component"), "actor": ("user", "actor")}


def template_regex(template: str) -> tuple[str, list[str]]:
    """A line template such as ``<time> <level> [<svc>] <message>`` as a regular expression, and its fields.

    A field goes to the next literal; blanks match any blanks; ``<<`` is a plain ``<``.
    """
    out, names = [], []
    for m in re.finditer(r"<<|<([A-Za-z_]\w*)>|\s+|[^<\s]+|<", template):
        if m[0] == "<<" or m[0] == "<":
            out.append("<")
        elif m[1]:
            names.append(m[1])
            out.append("(.*?)")
        else:
            out.append(r"[ \t]+" if m[0].isspace() else re.escape(m[0]))
    if not names or len(set(names)) != len(names):
        raise ValueError(f"template {template!r} needs fields, each of another name")
    return "^" + "".join(out) + "$", names


def templated(lines: DataFrame, template: str, source: str = "template") -> DataFrame:
    """Records of the lines that a template fits; fields that have no role become attributes."""
    pattern, names = template_regex(template)
    value = {n: F.regexp_extract("line", pattern, k + 1) for k, n in enumerate(names)}
    role = {r: next((n for n in names if n.lower() in usual), None) for r, usual in _ROLES.items()}
    get = lambda r, default: value[role[r]] if role[r] else F.lit(default)
    rest = [n for n in names if n not in role.values()]
    attrs = F.create_map(*(y for n in rest for y in (F.lit(n), value[n]))) if rest else F.create_map()
    return records(
        lines.where(F.col("line").rlike(pattern)), source, id=line_id(F.col("line"), F.col("file"), F.col("place")), at_ms=parsed_ms(get("time", "")), actor=F.nullif(get("actor", ""), F.lit("")),
        title=get("message", ""), level=F.upper(get("level", "")), attrs=attrs, touches=touch(F.coalesce(F.nullif(get("entity", ""), F.lit("")), F.lit("unknown")), "log-source"),
    )


# --- changelogs, journals, version control -------------------------------------------------------


def changelog(files: DataFrame, source: str = "changelog") -> DataFrame:
    """One record for each ``## [version] - date`` of whole files (``line`` is the text of a file).

    Its touches are the ``###`` sections, weighed by their bullets; a version that repeats gets ``#n``.
    """
    part = F.transform(F.slice(F.split("line", r"(?m)^## "), 2, 1_000_000), lambda x: x)
    rows = files.select("file", "place", F.posexplode(part).alias("nth", "text"))
    version = F.regexp_extract("text", r"^\[?([^\]\s]+)\]?", 1)
    day = F.regexp_extract("text", r"^[^\n]*?(\d{4}-\d{2}-\d{2})", 1)
    sections = F.filter(F.transform(F.slice(F.split("text", r"(?m)^### "), 2, 1000), _section), lambda t: t["weight"] > 0)
    rows = rows.withColumn("version", version).where("version <> ''")
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("file", "version").orderBy("nth"))
    rows = rows.withColumn("again", again)
    ident = F.concat(F.col("file"), F.lit(":"), "version", F.when(F.col("again") > 1, F.concat(F.lit("#"), F.col("again").cast("string"))).otherwise(""))
    at = F.unix_millis(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    return records(rows.withColumn("line", F.col("text")), source, id=ident, kind=F.lit("release"), at_ms=at, title=F.col("version"), body=F.col("text"), touches=sections, place=F.col("place") + F.col("nth"))


def _section(x: Column) -> Column:
    bullets = F.size(F.regexp_extract_all(x, F.lit(r"(?m)^[-*] "), F.lit(0))).cast("long")
    zero = F.lit(0).cast("long")
    return F.struct(F.lower(F.regexp_extract(x, r"^([^\n]+)", 1)).alias("entity"), F.lit("change-type").alias("type"), bullets.alias("weight"), zero.alias("added"), zero.alias("deleted"))


def journal(lines: DataFrame, source: str = "oslog") -> DataFrame:
    """Records of ``journalctl -o json``: priorities are syslog severities, times microseconds."""
    get = lambda k: F.get_json_object("line", f"$.{k}")
    text = get("MESSAGE")
    return records(
        lines.where(text.isNotNull()), source, id=F.coalesce(get("__CURSOR"), line_id(F.col("line"))), at_ms=F.floor(get("__REALTIME_TIMESTAMP").cast("long") / 1000), title=F.split(text, "\n")[0], body=text,
        level=_severity(F.coalesce(get("PRIORITY"), F.lit(""))), attrs=F.map_filter(F.create_map(F.lit("host"), get("_HOSTNAME"), F.lit("pid"), get("_PID")), lambda k, v: v.isNotNull()),
        touches=touch(F.coalesce(get("SYSLOG_IDENTIFIER"), get("_COMM"), F.lit("unknown")), "log-source"),
    )


def git_log(commits: DataFrame, source: str = "git") -> DataFrame:
    """Records of landed ``git log --numstat``: ``line`` is one commit, its fields parted by 0x1f.

    Fields: sha, author, email, seconds, iso, subject, body and numstat. A binary change counts -1
    lines and no weight; a rename counts for its new path.
    """
    f = lambda k: F.get(F.split("line", "\x1f"), k)
    stat = F.filter(F.split(F.coalesce(f(7), F.lit("")), "\n"), lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t."))
    text = F.concat_ws("\n", f(5), f(6))
    links = F.concat(F.transform(tickets(text), lambda x: F.struct(F.lit("ticket").alias("rel"), x.alias("target"))), F.filter(F.array(F.struct(F.lit("reverts").alias("rel"), reverted(f(6)).alias("target"))), lambda x: x["target"] != ""))
    return records(
        commits.where(f(0).rlike("^[0-9a-f]{7,64}$")), source, id=f(0), kind=F.lit("commit"), at_ms=f(3).cast("long") * 1000, actor=F.nullif(f(2), F.lit("")), actor_name=f(1), title=f(5), body=F.coalesce(f(6), F.lit("")),
        touches=F.transform(stat, _numstat), links=links,
    )


def _numstat(x: Column) -> Column:
    part = F.split(x, "\t", 3)
    lines = lambda k: F.when(part[k] == "-", -1).otherwise(part[k].cast("long")).cast("long")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(part[2], r"\{[^{}]*? => ([^{}]*)\}", "$1"), r"^.* => ", ""), "//", "/")
    weight = F.greatest(lines(0), F.lit(0)) + F.greatest(lines(1), F.lit(0))
    return F.struct(path.alias("entity"), F.lit("file").alias("type"), weight.cast("long").alias("weight"), lines(0).alias("added"), lines(1).alias("deleted"))


# --- files and telemetry -------------------------------------------------------------------------

# First bytes of file formats, in hex.
MAGIC = {"89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "25504446": "pdf", "504B0304": "zip", "1F8B": "gzip", "7F454C46": "elf", "50415231": "parquet", "53514C69746520666F726D61742033": "sqlite", "4D5A": "pe", "52494646": "riff", "42": "bmp-or-text"}
_FORMS = {"jpg": "jpeg", "gz": "gzip", "jar": "zip", "docx": "zip", "xlsx": "zip", "db": "sqlite"}


def directory(spark, path: str, root: str = "", source: str = "dir") -> DataFrame:  # noqa: ANN001
    """One record for each file under ``path``: size, times and the format that its first bytes say."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 15))
    form = F.lit("")
    for magic, name in sorted(MAGIC.items(), key=lambda x: len(x[0])):
        if name != "bmp-or-text":
            form = F.when(head.startswith(magic), name).otherwise(form)
    name = F.regexp_replace("path", "^file:/*", "/")
    if root:
        name = F.regexp_replace(name, "^" + re.escape(root.rstrip("/")) + "/", "")
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    usual = ext
    for k, v in _FORMS.items():
        usual = F.when(ext == k, v).otherwise(usual)
    mismatch = (form != "") & (ext != "") & (usual != form)
    attrs = F.create_map(F.lit("path"), name, F.lit("ext"), ext, F.lit("format"), form, F.lit("size"), F.col("length").cast("string"), F.lit("hash"), F.lower(F.hex(F.xxhash64("content"))), F.lit("ext_mismatch"), mismatch.cast("string"))
    rows = files.withColumn("line", name).withColumn("place", F.monotonically_increasing_id())
    return records(rows, source, id=F.concat(F.lit("file:"), name), kind=F.lit("file"), at_ms=F.unix_millis("modificationTime"), title=name, attrs=attrs, touches=touch(F.coalesce(F.nullif(F.regexp_extract(name, r"^(.*)/[^/]+$", 1), F.lit("")), F.lit(".")), "folder"))


def envelopes(lines: DataFrame, source: str = "nod") -> DataFrame:
    """Records of agent telemetry: lines ``{"nod": 1, "source": {...}, "events": [...]}``.

    Kind is ``nod.<type>``, id ``nod:<instance>:<run>:<seq>``; ``data`` is flattened, tools and edited
    files are touches, commits, tickets, files and urls links.
    """
    schema = "nod INT, source STRUCT<instance: STRING, run: STRING, host: STRING, profile: STRING>, events ARRAY<STRUCT<seq: LONG, ts: STRING, type: STRING, session: STRING, turn: STRING, agent: STRING, task: STRING, data: MAP<STRING, STRING>>>"
    rows = lines.withColumn("e", F.from_json("line", schema)).where("e.nod = 1").select("line", "place", F.col("e.source").alias("s"), F.posexplode("e.events").alias("nth", "x"))
    fixed = F.create_map(*(y for k, c in (("session", "x.session"), ("turn", "x.turn"), ("agent", "x.agent"), ("task", "x.task"), ("instance", "s.instance"), ("run", "s.run"), ("profile", "s.profile"), ("host", "s.host")) for y in (F.lit(k), F.col(c))))
    own = F.map_filter(fixed, lambda k, v: v.isNotNull())
    data = F.coalesce(F.col("x.data"), F.create_map().cast("map<string,string>"))
    clash = F.transform_keys(data, lambda k, v: F.when(F.array_contains(F.map_keys(own), k), F.concat(F.lit("data."), k)).otherwise(k))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    entity = lambda kind, prefix, c: F.struct(F.concat(F.lit(prefix), c).alias("entity"), F.lit(kind).alias("type"), one.alias("weight"), zero.alias("added"), zero.alias("deleted"))
    touched = F.filter(F.array(entity("tool", "tool/", data["tool"]), entity("edited-file", "edit:", data["edited"])), lambda t: t["entity"].isNotNull())
    links = F.filter(F.array(*(F.struct(F.lit(r).alias("rel"), data[r].alias("target")) for r in ("commit", "ticket", "url", "file"))), lambda x: x["target"].isNotNull())
    level = F.when((data["ok"] == "false") | F.col("x.type").endswith("error"), "ERROR").when(F.col("x.type").endswith("alert"), "WARN").otherwise("INFO")
    return records(
        rows, source, id=F.concat_ws(":", F.lit("nod"), "s.instance", "s.run", F.col("x.seq").cast("string")), kind=F.concat(F.lit("nod."), F.col("x.type")), at_ms=parsed_ms(F.col("x.ts")), title=F.concat_ws(" ", "x.type", data["tool"]),
        level=level, attrs=F.map_concat(own, clash), touches=touched, links=links, place=F.col("place"),
    )


def jobs(meta: DataFrame, audit_lines: DataFrame | None = None, source: str = "delega") -> DataFrame:
    """Records of job folders: ``meta`` has a row for each job (``job``, ``line``: KEY=VALUE text, ``place``).

    A job makes ``delega.job.start`` and, if it ended, ``delega.job.end``; lines of the audit file make
    ``delega.audit.<event>``.
    """
    pairs = F.str_to_map("line", F.lit("\n"), F.lit("="))
    rows = meta.withColumn("m", pairs)
    stages = F.array(
        F.struct(F.lit("start").alias("what"), parsed_ms(F.col("m")["started"]).alias("at")),
        F.struct(F.lit("end").alias("what"), parsed_ms(F.col("m")["ended"]).alias("at")),
    )
    rows = rows.select("*", F.explode(F.filter(stages, lambda x: (x["what"] == "start") | x["at"].isNotNull())).alias("x"))
    out = records(
        rows, source, id=F.concat_ws(":", F.lit("job"), "job", "x.what"), kind=F.concat(F.lit("delega.job."), F.col("x.what")), at_ms=F.col("x.at"), actor=F.col("m")["owner"], title=F.concat_ws(" ", F.lit("job"), "job", "x.what"),
        attrs=F.col("m"), touches=touch(F.col("job"), "job"), links=F.filter(F.array(F.struct(F.lit("commit").alias("rel"), F.col("m")["sha"].alias("target"))), lambda x: x["target"].isNotNull()),
    )
    if audit_lines is None:
        return out
    get = lambda k: F.get_json_object("line", f"$.{k}")
    attrs = F.map_filter(F.create_map(*(y for k in ("job", "profile", "node", "owner", "branch", "sha", "result", "cost_usd", "rc", "reason") for y in (F.lit(k), get(k)))), lambda k, v: v.isNotNull())
    entries = records(audit_lines.where(get("event").isNotNull()), source, id=line_id(F.col("line"), F.col("place")), kind=F.concat(F.lit("delega.audit."), get("event")), at_ms=parsed_ms(get("ts")), actor=get("owner"), title=F.concat_ws(" ", F.lit("audit"), get("event"), get("job")), attrs=attrs, touches=touch(F.coalesce(get("job"), F.lit("unknown")), "job"))
    return out.unionByName(entries)
