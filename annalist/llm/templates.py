"""A sandboxed template language, compiled to Python closures.

``compile_template`` parses a template into a syntax tree, folds what is constant, and turns the
tree into closures. They write text piece by piece, each piece marked if it lies in a
``generation`` block, so a conversation of any length is rendered while its messages stream by.

Language: text; ``{{ expression }}``; ``{% for x in xs %}…{% endfor %}`` with ``loop.index`` (from 1),
``loop.index0`` and ``loop.first``; ``{% if %}…{% elif %}…{% else %}…{% endif %}``;
``{% set x = expression %}``; ``{% generation %}…{% endgeneration %}``; ``{# comment #}``. Expressions:
strings, integers, true, false, none, names, ``a.b``, ``a['b']``, ``a[0]``, ``~`` (joins texts), ``+``,
``==``, ``!=``, ``<``, ``<=``, ``>``, ``>=``, ``in``, ``and``, ``or``, ``not``, parentheses, and filters
``|upper``, ``|lower``, ``|trim``, ``|length``, ``|default(x)`` and those that the caller adds. The
sandbox: values are texts, numbers, booleans, none, lists and dicts; ``a.b`` looks ``b`` up in a dict
and nowhere else; no calls but filters; no Python attribute is ever reached.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

Emit = Callable[[str, bool], None]
Scope = dict[str, Any]


class TemplateError(ValueError):
    """A template that can't be parsed, or asks for what the sandbox doesn't give."""


# --- syntax tree ---------------------------------------------------------------------------------


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Unary:
    op: str
    x: Any


@dataclass
class Binary:
    op: str
    a: Any
    b: Any


@dataclass
class Filter:
    x: Any
    name: str
    args: list[Any]


@dataclass
class Text:
    text: str


@dataclass
class Output:
    x: Any


@dataclass
class For:
    name: str
    over: Any
    body: list[Any]


@dataclass
class If:
    tests: list[tuple[Any, list[Any]]]
    other: list[Any] = field(default_factory=list)


@dataclass
class Set:
    name: str
    x: Any


@dataclass
class Generation:
    body: list[Any]


# --- parser --------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-~+<>.,()\[\]|=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~", "+"))


class _Expressions:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or wanted and got not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted) or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"expected a name, found {self.peek() or 'the end'}")
        got = self.take()
        if got.startswith("_"):
            raise TemplateError(f"the name {got} is not allowed")
        return got

    def whole(self) -> Any:
        out = self.level(0)
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()}")
        return out

    def level(self, k: int) -> Any:
        if k == len(_LEVELS):
            return self.piped()
        if k == 2 and self.peek() == "not":
            self.take()
            return Unary("not", self.level(2))
        out = self.level(k + 1)
        while self.peek() in _LEVELS[k] and self.tokens[self.at][0] != "str":
            out = Binary(self.take(), out, self.level(k + 1))
        return out

    def piped(self) -> Any:
        out = self.single()
        while self.peek() in (".", "[", "|") and self.tokens[self.at][0] == "op":
            op = self.take()
            if op == ".":
                out = Item(out, Const(self.name()))
            elif op == "[":
                out = Item(out, self.level(0))
                self.take("]")
            else:
                name, args = self.name(), []
                if self.peek() == "(":
                    self.take()
                    while self.peek() != ")":
                        args.append(self.level(0))
                        if self.peek() != ")":
                            self.take(",")
                    self.take(")")
                out = Filter(out, name, args)
        return out

    def single(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        if kind == "name":
            if text in _WORDS:
                self.take()
                return Const(_WORDS[text])
            return Name(self.name())
        self.take()
        if kind == "int":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if text == "(":
            out = self.level(0)
            self.take(")")
            return out
        raise TemplateError(f"unexpected {text}")


def parse(source: str) -> list[Any]:
    """The syntax tree of a template: a list of statements."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        at = m.end()
        if m["out"] is not None:
            parts.append(("out", m["out"]))
        elif m["tag"] is not None:
            parts.append(("tag", m["tag"].strip()))
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def block(*ends: str) -> tuple[list[Any], str]:
        out: list[Any] = []
        while parts:
            kind, body = parts.pop()
            word = body.split(None, 1)[0] if kind == "tag" and body else ""
            rest = body[len(word) :]
            if kind == "text":
                out.append(Text(body))
            elif kind == "out":
                out.append(Output(_Expressions(body).whole()))
            elif word in ends:
                return out, body
            elif word == "for":
                x = _Expressions(rest)
                name = x.name()
                x.take("in")
                out.append(For(name, x.whole(), block("endfor")[0]))
            elif word == "set":
                x = _Expressions(rest)
                name = x.name()
                x.take("=")
                out.append(Set(name, x.whole()))
            elif word == "generation":
                out.append(Generation(block("endgeneration")[0]))
            elif word == "if":
                node = If([])
                test = rest
                while True:
                    inner, end = block("elif", "else", "endif")
                    node.tests.append((_Expressions(test).whole(), inner))
                    if not end.startswith("elif"):
                        break
                    test = end[4:]
                if end == "else":
                    node.other = block("endif")[0]
                out.append(node)
            else:
                raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return block()[0]


# --- folding -------------------------------------------------------------------------------------


def _text(x: Any) -> str:
    if x is None:
        return ""
    return ("true" if x else "false") if isinstance(x, bool) else str(x)


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def _compare(test: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    def run(a: Any, b: Any) -> bool:
        try:
            return bool(test(a, b))
        except TypeError:
            return False

    return run


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "~": lambda a, b: _text(a) + _text(b),
    "+": _plus,
    "==": operator.eq,
    "!=": operator.ne,
    "<": _compare(operator.lt),
    "<=": _compare(operator.le),
    ">": _compare(operator.gt),
    ">=": _compare(operator.ge),
    "in": _compare(lambda a, b: a in b),
}
_FILTERS: dict[str, Callable[..., Any]] = {
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "trim": lambda x: _text(x).strip(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "default": lambda x, other="": other if x is None else x,
}


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def fold(node: Any, filters: dict[str, Callable[..., Any]]) -> Any:
    """The same tree with constant parts worked out, dead branches gone and adjacent texts joined."""
    if isinstance(node, list):
        out: list[Any] = []
        for x in (fold(y, filters) for y in node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return out
    if isinstance(node, Output):
        x = fold(node.x, filters)
        return Text(_text(x.value)) if isinstance(x, Const) else Output(x)
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.x, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        tests = []
        for test, body in node.tests:
            test = fold(test, filters)
            if isinstance(test, Const):
                if not test.value:
                    continue
                if not tests:
                    return fold(body, filters)
                return If(tests, fold(body, filters))
            tests.append((test, fold(body, filters)))
        other = fold(node.other, filters)
        return If(tests, other) if tests else other
    if isinstance(node, Item):
        of, key = fold(node.of, filters), fold(node.key, filters)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Unary):
        x = fold(node.x, filters)
        return Const(not x.value) if isinstance(x, Const) else Unary(node.op, x)
    if isinstance(node, Binary):
        a, b = fold(node.a, filters), fold(node.b, filters)
        if node.op in ("and", "or"):
            if isinstance(a, Const):
                return b if bool(a.value) == (node.op == "and") else a
        elif isinstance(a, Const) and isinstance(b, Const):
            return Const(_BINARY[node.op](a.value, b.value))
        return Binary(node.op, a, b)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name}")
        x, args = fold(node.x, filters), [fold(y, filters) for y in node.args]
        if all(isinstance(y, Const) for y in (x, *args)):
            return Const(filters[node.name](x.value, *(y.value for y in args)))
        return Filter(x, node.name, args)
    return node


# --- closures ------------------------------------------------------------------------------------


def _value(node: Any, filters: dict[str, Callable[..., Any]]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)
        return lambda scope: _item(of(scope), key(scope))
    if isinstance(node, Unary):
        x = _value(node.x, filters)
        return lambda scope: not x(scope)
    if isinstance(node, Filter):
        run, x, args = filters[node.name], _value(node.x, filters), [_value(y, filters) for y in node.args]
        return (lambda scope: run(x(scope), *(y(scope) for y in args))) if args else (lambda scope: run(x(scope)))
    a, b = _value(node.a, filters), _value(node.b, filters)
    if node.op == "and":
        return lambda scope: a(scope) and b(scope)
    if node.op == "or":
        return lambda scope: a(scope) or b(scope)
    op = _BINARY[node.op]
    return lambda scope: op(a(scope), b(scope))


def _run(nodes: list[Any], filters: dict[str, Callable[..., Any]], masked: bool) -> Callable[[Scope, Emit], None]:
    steps = [_step(x, filters, masked) for x in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: Scope, emit: Emit) -> None:
        for step in steps:
            step(scope, emit)

    return run


def _step(node: Any, filters: dict[str, Callable[..., Any]], masked: bool) -> Callable[[Scope, Emit], None]:
    if isinstance(node, Text):
        text = node.text
        return lambda scope, emit: emit(text, masked)
    if isinstance(node, Output):
        x = _value(node.x, filters)
        return lambda scope, emit: emit(_text(x(scope)), masked)
    if isinstance(node, Generation):
        return _run(node.body, filters, True)
    if isinstance(node, Set):
        name, value = node.name, _value(node.x, filters)
        return lambda scope, emit: scope.__setitem__(name, value(scope))
    if isinstance(node, If):
        tests = [(_value(t, filters), _run(b, filters, masked)) for t, b in node.tests]
        other = _run(node.other, filters, masked)

        def choose(scope: Scope, emit: Emit) -> None:
            for test, body in tests:
                if test(scope):
                    return body(scope, emit)
            other(scope, emit)

        return choose
    item, over, body = node.name, _value(node.over, filters), _run(node.body, filters, masked)

    def loop(scope: Scope, emit: Emit) -> None:
        inner = dict(scope)
        xs = over(scope)
        for k, x in enumerate(xs if isinstance(xs, (list, Stream)) else ()):
            inner[item], inner["loop"] = x, {"index": k + 1, "index0": k, "first": k == 0}
            body(inner, emit)

    return loop


class Stream:
    """Messages that are read once, as they come."""

    def __init__(self, items: Iterable[Any]):
        self.items = items

    def __iter__(self):
        return iter(self.items)


class Template:
    """A compiled template."""

    def __init__(self, source: str, filters: dict[str, Callable[..., Any]] | None = None):
        known = _FILTERS | (filters or {})
        self.tree = fold(parse(source), known)
        self._run = _run(self.tree, known, False)

    def stream(self, emit: Emit, **values: Any) -> None:
        """Hand every piece of text to ``emit``, with whether it lies in a generation block."""
        self._run(values, emit)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and start and end of each stretch of it that lies in a generation block."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def emit(text: str, masked: bool) -> None:
            nonlocal at
            if masked and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            parts.append(text)
            at += len(text)

        self.stream(emit, **values)
        return "".join(parts), spans
