"""Scalar functions on text: templates of messages, levels, secrets, hashes, tickets and reverts."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- templates of messages -----------------------------------------------------------------------

_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_IP = re.compile(r"((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|(?=:|$))){4}(:\d+)?", re.A)
_DAY, _CLOCK = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}(:?\d{2})?)?"
_TIME = re.compile(rf"{_DAY}|({_DAY}T)?{_CLOCK}", re.A)
_EDGE = re.compile(r"^([^\w\-.:/]*)(.*?)([^\w\-.:/]*)$", re.S)
_SEPARATORS = re.compile(r"([/=@:,])")
_RUN = re.compile(r"(<(?:UUID|IP|TS|HEX|NUM)>|\w)+")
_DIGITS = re.compile(r"\d+", re.A)


def _is_hex(x: str) -> bool:
    if x[:2] in ("0x", "0X"):
        return len(x) > 2 and re.fullmatch("[0-9a-fA-F]+", x[2:]) is not None
    if len(x) < 6 or not re.fullmatch("[0-9a-fA-F]+", x):
        return False
    letter, digit = re.search("[a-fA-F]", x), re.search("[0-9]", x)
    return bool(letter) and (len(x) >= 8 or bool(digit))


def _whole(x: str) -> str | None:
    if _UUID.fullmatch(x):
        return "<UUID>"
    if _IP.fullmatch(x):
        return "<IP>"
    if _TIME.fullmatch(x):
        return "<TS>"
    return "<HEX>" if _is_hex(x) else None


@lru_cache(1 << 16)
def _token(token: str) -> str:
    before, core, after = _EDGE.match(token).groups()
    if not core:
        return token
    if whole := _whole(core):
        return before + whole + after
    parts = [
        x if k % 2 else _whole(x) or _RUN.sub(lambda m: "<HEX>" if _is_hex(m[0]) else _DIGITS.sub("<NUM>", m[0]), x)
        for k, x in enumerate(_SEPARATORS.split(core))
    ]
    return before + "".join(parts) + after


def template_of(text: str | None) -> str:
    """The message with its variable parts marked: ``<UUID>``, ``<IP>``, ``<TS>``, ``<HEX>``, ``<NUM>``.

    Applying it to its own result changes nothing.
    """
    return " ".join(_token(x) if len(x) < 200 else _token.__wrapped__(x) for x in (text or "").split())


def bare_template(template: Column) -> Column:
    """A template without the times and numbers that a line began with."""
    return F.regexp_replace(template, r"^(<TS> |UTC |\[<NUM>\] )+", "")


# --- levels --------------------------------------------------------------------------------------

# Level words as log lines spell them, with the level that each means.
LEVEL_WORDS = {
    "PANIC": "FATAL",
    "FATAL": "FATAL",
    "CRITICAL": "CRITICAL",
    "CRIT": "CRITICAL",
    "ERROR": "ERROR",
    "WARNING": "WARNING",
    "WARN": "WARNING",
}
_WORD = r"(?<![A-Za-z0-9])(PANIC|FATAL|CRITICAL|CRIT|ERROR|WARNING|WARN)(?=$|[:\] \t|>])"
_PAIR = r'(?:level=|"level": ?")(panic|fatal|critical|crit|error|warning|warn)(?![a-z])'


def inferred_level(text: Column) -> Column:
    """The level that the first line of ``text`` names within 200 characters; '' if none."""
    line = F.substring(F.split(F.coalesce(text, F.lit("")), "\n")[0], 1, 200)
    word = F.regexp_extract(line, _WORD, 1)
    pair = F.upper(F.regexp_extract(F.lower(line), _PAIR, 1))
    found = F.when(word != "", word).otherwise(pair)
    out = F.lit("")
    for k, v in LEVEL_WORDS.items():
        out = F.when(found == k, v).otherwise(out)
    return out


def severity(level: Column) -> Column:
    """0 for the worst levels, 4 for those that aren't failures."""
    up = F.upper(level)
    return F.when(up.isin("FATAL", "PANIC"), 0).when(up == "CRITICAL", 1).when(up == "ERROR", 2).when(up.isin("WARN", "WARNING"), 3).otherwise(4)


# --- secrets -------------------------------------------------------------------------------------

SECRET = "<SECRET>"
# Prefixes of public token formats, each with the least length of what follows.
_PREFIXES = {
    "ghp_": 30, "gho_": 30, "ghu_": 30, "ghs_": 30, "ghr_": 30, "github_pat_": 40, "glpat-": 20, "xoxb-": 20, "xoxp-": 20, "xoxa-": 20, "xoxs-": 20, "xapp-": 20,
    "sk-ant-": 30, "sk-proj-": 30, "sk-": 32, "AKIA": 16, "ASIA": 16, "AIza": 35, "ya29.": 30, "npm_": 30, "pypi-": 40, "hf_": 30,
}
# Parts of names whose values are secrets.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "client_secret", "authorization", "auth_token", "cookie")
_PROVIDER = re.compile("(?<![A-Za-z0-9_])(" + "|".join(rf"{re.escape(p)}[A-Za-z0-9_\-]{{{n},}}" for p, n in _PREFIXES.items()) + ")")
_JWT = re.compile(r"eyJ[A-Za-z0-9_\-]{7,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]*")
_BEARER = re.compile(r"(?i)\b(bearer|basic)(\s+)([A-Za-z0-9+/=_\-.~]{4,})")
_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*://)([^\s/?#]*)@")
_PAIRED = re.compile(r"""(?i)([\w.\-]*(?:%s)[\w.\-]*)(["']?\s*[=:]\s*)("[^"]*"|'[^']*'|[^\s,;&"']+)""" % "|".join(map(re.escape, SENSITIVE)))
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)


def sensitive(key: str) -> bool:
    """Whether a name says that its value is a secret."""
    low = key.lower()
    return any(x in low for x in SENSITIVE)


def _mixed(x: str) -> bool:
    return bool(re.search("[0-9]", x)) and bool(re.search("[A-Za-z]", x)) or len(set(x)) > 12


def redacted(text: str | None) -> tuple[str, int]:
    """``text`` with secrets replaced, and how many there were."""
    found = 0

    def hide(m: re.Match, keep: str = "") -> str:
        nonlocal found
        found += 1
        return keep + SECRET

    def credential(m: re.Match) -> str:
        value = m[3]
        if len(value) < 16:
            if m[1].lower() != "basic":
                return m[0]
            try:
                if b":" not in base64.b64decode(value, validate=True):
                    return m[0]
            except (binascii.Error, ValueError):
                return m[0]
        return hide(m, m[1] + m[2])

    def authority(m: re.Match) -> str:
        user, colon, password = m[2].partition(":")
        return hide(m, f"{m[1]}{user}:") + "@" if colon and password and password != SECRET else m[0]

    def pair(m: re.Match) -> str:
        value = m[3]
        quote = value[0] if value[0] in "\"'" else ""
        bare = value.strip("\"'") if quote else value
        if len(bare) < 8 or bare.isdigit() or bare == SECRET or bare[0] in "</~" or "://" in bare or (not quote and bare.isalpha() and " " in m[2]):
            return m[0]
        return hide(m, m[1] + m[2] + quote) + quote

    out = _PEM.sub(hide, text or "")
    out = _JWT.sub(hide, out)
    out = _PROVIDER.sub(lambda m: hide(m) if _mixed(m[0]) else m[0], out)
    out = _BEARER.sub(credential, out)
    out = _URL.sub(authority, out)
    return _PAIRED.sub(pair, out), found


# --- hashes --------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1


@lru_cache(1 << 16)
def fnv64(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & _MASK
    return h


_ALNUM = re.compile(r"[^\W_]+")


def simhash_of(text: str | None) -> int:
    """64-bit SimHash of the lower-cased words of ``text``, as a signed long; 0 without words."""
    hashes = np.array([fnv64(word.encode()) for word in _ALNUM.findall((text or "").lower())], np.uint64)
    ones = sum((_ones(hashes[k : k + 65536]) for k in range(0, len(hashes), 65536)), np.zeros(64, np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


# How lines of a commit message begin that say nothing about the change.
TRAILERS = (
    "co-authored-by:", "signed-off-by:", "reviewed-by:", "acked-by:", "tested-by:", "reported-by:", "cc:", "fixes:", "closes:", "refs:", "see-also:", "author:", "date:",
)

# --- what commit messages say --------------------------------------------------------------------


def tickets(text: Column) -> Column:
    """Distinct ticket names, in order: ``#12`` and ``ABC-12``."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9_&/#])(#[0-9]+|[A-Z][A-Z0-9]*-[0-9]+)(?![A-Za-z0-9_])"), F.lit(1)))


def reverted(text: Column) -> Column:
    """The commit that a message says it reverts; '' if none."""
    return F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?im)^\s*this reverts commit\s+([0-9a-fA-F]{7,40})", 1))


def conventional_kind(title: Column) -> Column:
    """The type of a conventional commit title (``fix(core)!: …`` is ``fix``); '' if it isn't one."""
    return F.lower(F.regexp_extract(F.coalesce(title, F.lit("")), r"^([A-Za-z]+)(?:\([^)]*\))?!?: ", 1))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, and nothing else: comparisons of texts and levels see no other case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: str) -> str:
    """``ascii_lower`` of a value."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def top_segments(entities: Column) -> Column:
    """The distinct first segments of an event's entities, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(entities, lambda x: F.split_part(x, F.lit("/"), F.lit(1))), lambda x: x != "")))


def short_id(ident: Column, length: int = 8) -> Column:
    """The first characters of an id, as lists show it."""
    return F.left(ident, F.lit(length))


def longest_literal(template: Column, most: int = 70) -> Column:
    """The longest stretch of a template between its marks, without blanks and brackets around it; the first of equals."""
    parts = F.split(F.coalesce(template, F.lit("")), "<[^>]*>?")
    sized = F.transform(parts, lambda x, i: F.struct(F.length(F.trim(x)).alias("n"), (-i).alias("i"), x.alias("x")))
    best = F.array_max(sized)["x"]
    return F.left(F.regexp_replace(best, r'^[\s\[\]():,"]+|[\s\[\]():,"]+$', ""), F.lit(most))


def clean_body(body: Column) -> Column:
    """The lines of a message that say something: no empty ones, no trailers, none with an address."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    low = lambda x: F.lower(x)
    kept = F.filter(lines, lambda x: (x != "") & ~low(x).rlike("^(" + "|".join(map(re.escape, TRAILERS)) + ")") & ~low(x).contains("noreply") & ~low(x).contains("://"))
    return F.array_join(kept, "\n")


def closest(name: str, known: list[str], most: int = 2) -> str | None:
    """The one of ``known`` with the least edit distance to ``name``, the first of equals; None if all differ by more than ``most``."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            left, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                left, row[j + 1] = row[j + 1], min(left + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    found = min(((distance(name, k), i, k) for i, k in enumerate(known)), default=(most + 1, 0, ""))
    return found[2] if found[0] <= most else None


def top_dir(entity: Column) -> Column:
    """The first two segments of a path; ``(root)`` for a single one."""
    parts = F.split(entity, "/")
    return F.when(F.size(parts) == 1, "(root)").otherwise(F.concat_ws("/", parts[0], parts[1]))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, accents removed."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")


# --- as columns ----------------------------------------------------------------------------------


def _batched(run: Callable, kind: str) -> Callable[[Column], Column]:
    """``run`` over Arrow batches; each distinct text of a batch is worked out once."""

    @F.pandas_udf(kind)
    def batch(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts.fillna(""))
        return pd.Series([run(x) for x in distinct], dtype=object).take(codes).reset_index(drop=True)

    return batch


def templatize(text: Column) -> Column:
    return _batched(template_of, "string")(text)


def simhash(text: Column) -> Column:
    return _batched(simhash_of, "long")(text)


def redact(text: Column) -> Column:
    return _batched(lambda x: redacted(x)[0], "string")(text)


def secrets(text: Column) -> Column:
    """How many secrets ``redact`` replaces."""
    return _batched(lambda x: redacted(x)[1], "int")(text)
