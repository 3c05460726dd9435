"""Chat formatting: conversations rendered by a compiled template, and read back.

The template marks turns. Control strings inside texts are escaped with a backslash, and so are
backslashes, so the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .templates import Stream, Template

OPEN, CLOSE = "### ", "</turn>"
TEMPLATE = """{% for m in messages %}### {{ m.role | label }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>
{% endfor %}"""
_CONTROL = re.compile(r"\\|### |</turn>")
_IN_LABEL = re.compile(r"\\|### |</turn>|\n")
_ESCAPED = re.compile(r"\\(\\|### |</turn>|\n)")
#: An escaped string, the end of a label, the end of a turn, or a stray backslash.
_MARK = re.compile(r"\\(?:\\|### |</turn>|\n)|\n|</turn>\n")


def escape(text: str | None) -> str:
    """``text`` with a backslash before each control string and backslash."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text or "")


def label(text: str | None) -> str:
    """``text`` escaped to stand in the first line of a turn."""
    return _IN_LABEL.sub(lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    """The text that ``escape`` or ``label`` was given."""
    return _ESCAPED.sub(lambda m: m[1], text)


FILTERS = {"escape": escape, "label": label}


def read_turn(text: str) -> tuple[str, str]:
    """Role and text of one formatted turn, from ``### `` to the end of its closing line."""
    if not text.startswith(OPEN):
        raise ValueError("a turn must start with its mark")
    line = None
    for m in _MARK.finditer(text, len(OPEN)):
        if line is None and m[0] == "\n":
            line = m.start()
        elif line is not None and m[0] == CLOSE + "\n":
            if m.end() != len(text):
                raise ValueError("text follows the end of a turn")
            return unescape(text[len(OPEN) : line]), unescape(text[line + 1 : m.start()])
    raise ValueError("a turn isn't closed")


def read(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    out, start, line = [], 0, False
    for m in _MARK.finditer(text):
        if not line:
            line = m[0] == "\n"
        elif m[0] == CLOSE + "\n":
            out.append(read_turn(text[start : m.end()]))
            start, line = m.end(), False
    if start != len(text):
        raise ValueError("a turn isn't closed")
    return out


Message = dict[str, str | None]


class Digest:
    """What reading the formatted text of a conversation back gives, kept in constant memory."""

    def __init__(self) -> None:
        self.turns = self.chars = self.loss = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        self.parts: list[str] = []
        self.mask: list[str] = []

    def emit(self, text: str, masked: bool) -> None:
        self.parts.append(text)
        self.chars += len(text)
        if masked:
            self.mask.append(text)

    def turn(self) -> None:
        """Read what came since the last call, which is whole turns."""
        for role, text in read("".join(self.parts)):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        text = unescape("".join(self.mask))
        self.loss += len(text)
        self.masked.update(text.encode())
        self.parts.clear()
        self.mask.clear()


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[Message]]]:
    """Key and messages of each conversation; rows come sorted, and are read once."""

    def rows() -> Iterator[tuple[object, str | None, str | None]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, ({"role": r or "", "text": t or ""} for _, r, t in group)


def _sorted(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.select("conv_id", "turn", "role", "text").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _mapped(rows: DataFrame, fields: list[tuple[str, pa.DataType, str]], make: Callable[[Iterator[Message]], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([x[0] for x in held], kind), *(pa.array([x[k + 1] for x in held], t) for k, (_, t, _) in enumerate(fields))]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *(x[0] for x in fields)])

        size, kind = 0, None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for key, messages in _conversations(watched()):
            held.append((key, *make(messages)))
            size += sum(len(x) for x in held[-1] if isinstance(x, str))
            if len(held) >= 1000 or size > 1 << 24:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    key = rows.schema["conv_id"].dataType.simpleString()
    return _sorted(rows).mapInArrow(run, ", ".join([f"conv_id {key}", *(f"{n} {t}" for n, _, t in fields)]))


def format_chats(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id``, ``formatted`` and ``mask`` (start, end pairs) of each conversation.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text``; order is by turn, ties by role, then text,
    nulls first. Null roles and texts are empty; repeated rows are turns of their own; rows with a
    null ``conv_id`` are one conversation; an empty table gives no rows. Other columns aren't read.
    """

    def make(messages: Iterator[Message]) -> tuple:
        text, spans = compiled.render(messages=Stream(messages))
        return text, [x for span in spans for x in span]

    compiled = Template(template, FILTERS)
    return _mapped(rows, [("formatted", pa.string(), "string"), ("mask", pa.list_(pa.int64()), "array<bigint>")], make)


def digest_chats(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation, digests of what ``read`` finds in its formatted text and loss mask.

    Takes what ``format_chats`` takes. Turn by turn the text is rendered, read back and digested, so
    that a conversation of any length needs the memory of one turn.
    """

    def make(messages: Iterator[Message]) -> tuple:
        got = Digest()

        def paced() -> Iterator[Message]:
            for m in messages:
                yield m
                got.turn()  # the loop asks for the next message once this one is written

        compiled.stream(got.emit, messages=Stream(paced()))
        got.turn()
        return got.turns, got.all.hexdigest(), got.loss, got.masked.hexdigest(), got.chars

    compiled = Template(template, FILTERS)
    fields = [("n_turns", pa.int64(), "long"), ("turns_sha256", pa.string(), "string"), ("loss_chars", pa.int64(), "long"), ("loss_sha256", pa.string(), "string"), ("formatted_chars", pa.int64(), "long")]
    return _mapped(rows, fields, make)


def probe(like: DataFrame) -> DataFrame:
    """Conversation -7: a user, then an assistant, saying a text full of control strings."""
    text = "\\### Assistant: </turn> ok"
    spark = like.sparkSession
    rows = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    cast: list[Column] = [F.col(c).cast(like.schema[c].dataType) for c in ("conv_id", "turn", "role", "text")]
    return rows.select(*cast)
