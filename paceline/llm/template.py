"""A small template language, compiled to Python closures.

Text stands for itself.  ``{{ expression }}`` prints a value; ``{% for x in e %}``,
``{% if e %}``, ``{% elif e %}``, ``{% else %}``, ``{% set x = e %}`` and
``{% generation %}`` are blocks, the latter marking what a model is to learn.  A ``-``
inside a bracket (``{%-``, ``-%}``) takes the white space beside it away.

Expressions: strings, whole numbers, true, false, none, names, ``a.b``, ``a[b]``,
``+``, ``%``, comparisons, ``in``, ``not``, ``and``, ``or``, ``x if c else y``, and filters
``x | name``.  There are no calls and no attributes: ``a.b`` looks a key up in a
mapping, so a template reaches nothing but the values it is given.

A source is parsed to a tree, constants are folded (expressions, branches that
can't be taken, text beside text), and each node becomes a closure.  Closures are
generators: a loop takes its items one at a time, so a conversation of any length
is rendered in the memory of one turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

#: Blocks inside blocks, and brackets inside brackets, a template may have.
DEEPEST = 50

Piece = tuple[str, bool]  # text, and whether a model learns it


class TemplateError(ValueError):
    """A template that can't be compiled, or a value it can't use."""


# The tree.


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter with its operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Choose:
    """``then`` or ``other`` (also and / or, whose second operand may stay unread)."""

    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _string(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool | int):
        return {None: "", True: "true", False: "false"}.get(value, str(value)) if value is None or isinstance(value, bool) else str(value)
    raise TemplateError(f"can't print a {type(value).__name__}")


def _contains(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return _string(a) in b
    if isinstance(b, Mapping | list | tuple):
        return a in b
    raise TemplateError(f"can't look into a {type(b).__name__}")


def _numbers(a: Any, b: Any) -> None:
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("not numbers")


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, str) or isinstance(b, str):
        return _string(a) + _string(b)
    _numbers(a, b)
    return a + b


def _modulo(a: Any, b: Any) -> int:
    _numbers(a, b)
    if not b:
        raise TemplateError("modulo zero")
    return a % b


def _less(a: Any, b: Any) -> bool:
    if type(a) is not type(b) or not isinstance(a, str | int):
        raise TemplateError("can't order these")
    return a < b


def _length(v: Any) -> int:
    if not isinstance(v, str | list | tuple | Mapping):
        raise TemplateError(f"a {type(v).__name__} has no length")
    return len(v)


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _less,
    ">": lambda a, b: _less(b, a),
    "<=": lambda a, b: not _less(b, a),
    ">=": lambda a, b: not _less(a, b),
    "in": _contains,
    "not in": lambda a, b: not _contains(a, b),
    "not": lambda a: not a,
    "+": _add,
    "%": _modulo,
}

FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _string(v).strip(),
    "upper": lambda v: _string(v).upper(),
    "lower": lambda v: _string(v).lower(),
    "length": _length,
}

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+%().|=\[\]]))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_WORDS = {"if", "else", "and", "or", "not", "in", *_CONSTANTS}


class _Expression:
    """Reads one expression after the other from the inside of a bracket."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or value in _WORDS:
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> Any:
        value = self.choice()
        self.end()
        return value

    def choice(self) -> Any:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("too deep")
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.expect("else")
            value = Choose(test, value, self.choice())
        self.depth -= 1
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Choose(value, value, self.both())
        return value

    def both(self) -> Any:
        value = self.negation()
        while self.take("and"):
            value = Choose(value, self.negation(), value)
        return value

    def negation(self) -> Any:
        negated = False
        while self.take("not"):
            negated = not negated
        value = self.comparison()
        return Apply("not", (value,)) if negated else value

    def comparison(self) -> Any:
        value = self.sum()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in", "not"):
            sign = self.tokens[self.at][1]
            self.at += 1
            if sign == "not":
                self.expect("in")
                sign = "not in"
            value = Apply(sign, (value, self.sum()))
        return value

    def sum(self) -> Any:
        value = self.filtered()
        while self.peek("+", "%"):
            sign = self.tokens[self.at][1]
            self.at += 1
            value = Apply(sign, (value, self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.value()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            value = Apply("|" + name, (value,))
        return value

    def value(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            value = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        elif kind == "number":
            value = Const(int(token))
        elif kind == "name" and token in _CONSTANTS:
            value = Const(_CONSTANTS[token])
        elif kind == "name" and token not in _WORDS:
            value = Name(token)
        elif token == "(":
            value = self.choice()
            self.expect(")")
        else:
            raise TemplateError(f"unexpected {token!r}")
        while self.peek(".", "["):
            if self.take("."):
                value = Item(value, Const(self.name()))
            else:
                self.expect("[")
                value = Item(value, self.choice())
                self.expect("]")
        return value


_BRACKET = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.S)


def _split(source: str) -> Iterator[tuple[str, str]]:
    """(kind, inside) of text, prints and blocks in turn."""
    at, strip = 0, False
    for m in [*_BRACKET.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if "{{" in text or "{%" in text:
            raise TemplateError("a bracket is not closed")
        if strip:
            text = text.lstrip()
        if m and m[0][2] == "-":
            text = text.rstrip()
        if text:
            yield "text", text
        if not m:
            return
        strip = m[0][-3] == "-" and len(m[0]) > 4
        at = m.end()
        if m[0][1] != "#":
            yield ("print" if m[0][1] == "{" else "block"), m[0][2:-2].strip("-").strip()


def parse(source: str, filters: Mapping[str, Callable] | None = None) -> tuple:
    """The tree of a template's source."""
    filters = FILTERS | dict(filters or {})
    parts = list(_split(source))
    at = 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal at
        if depth > DEEPEST:
            raise TemplateError("too deep")
        nodes = []
        while at < len(parts):
            kind, inside = parts[at]
            at += 1
            if kind == "text":
                nodes.append(Text(inside))
                continue
            if kind == "print":
                nodes.append(Print(_Expression(inside, filters).whole()))
                continue
            word, _, rest = inside.partition(" ")
            e = _Expression(rest, filters)
            if word in ends:
                return tuple(nodes), inside
            if word == "for":
                name = e.name()
                e.expect("in")
                over = e.whole()
                inner, _ = body(("endfor",), depth + 1)
                nodes.append(For(name, over, inner))
            elif word == "if":
                nodes.append(branch(e.whole(), depth))
            elif word == "set":
                name = e.name()
                e.expect("=")
                nodes.append(Assign(name, e.whole()))
            elif word == "generation":
                e.end()
                inner, _ = body(("endgeneration",), depth + 1)
                nodes.append(Generation(inner))
            else:
                raise TemplateError(f"unexpected {inside!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    def branch(test: Any, depth: int) -> If:
        then, end = body(("elif", "else", "endif"), depth + 1)
        other: tuple = ()
        if end.startswith("elif"):
            other = (branch(_Expression(end[4:], filters).whole(), depth + 1),)
        elif end == "else":
            other, _ = body(("endif",), depth + 1)
        return If(test, then, other)

    return body((), 0)[0]


def _fold_value(node: Any, functions: Mapping[str, Callable]) -> Any:
    if isinstance(node, Item):
        return Item(_fold_value(node.of, functions), _fold_value(node.key, functions))
    if isinstance(node, Apply):
        args = tuple(_fold_value(a, functions) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(functions[node.name](*(a.value for a in args)))
            except TemplateError:
                pass  # an error only if it is ever reached
        return Apply(node.name, args)
    if isinstance(node, Choose):
        test = _fold_value(node.test, functions)
        if isinstance(test, Const):
            return _fold_value(node.then if test.value else node.other, functions)
        return Choose(test, _fold_value(node.then, functions), _fold_value(node.other, functions))
    return node


def fold(nodes: Iterable, functions: Mapping[str, Callable]) -> tuple:
    """The tree with constants worked out and neighbouring text joined."""
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not (isinstance(node, Text) and not node.text):
            out.append(node)

    for node in nodes:
        if isinstance(node, Print):
            value = _fold_value(node.value, functions)
            add(Text(_string(value.value)) if isinstance(value, Const) else Print(value))
        elif isinstance(node, If):
            test = _fold_value(node.test, functions)
            then, other = fold(node.then, functions), fold(node.other, functions)
            if isinstance(test, Const):
                for inner in then if test.value else other:
                    add(inner)
            else:
                add(If(test, then, other))
        elif isinstance(node, For):
            add(For(node.name, _fold_value(node.over, functions), fold(node.body, functions)))
        elif isinstance(node, Assign):
            add(Assign(node.name, _fold_value(node.value, functions)))
        elif isinstance(node, Generation):
            body = fold(node.body, functions)
            if body:
                add(Generation(body))
        else:
            add(node)
    return tuple(out)


def _value_closure(node: Any, functions: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):

        def name(scope: dict, k: str = node.name) -> Any:
            if k not in scope:
                raise TemplateError(f"no value {k!r}")
            return scope[k]

        return name
    if isinstance(node, Item):
        of, key = _value_closure(node.of, functions), _value_closure(node.key, functions)

        def item(scope: dict) -> Any:
            holder, k = of(scope), key(scope)
            try:
                if isinstance(holder, Mapping) or isinstance(holder, str | list | tuple) and type(k) is int:
                    return holder[k]
            except (KeyError, IndexError):
                pass
            raise TemplateError(f"no item {k!r}")

        return item
    if isinstance(node, Apply):
        f, args = functions[node.name], [_value_closure(a, functions) for a in node.args]
        if len(args) == 1:
            return lambda scope, f=f, a=args[0]: f(a(scope))
        return lambda scope, f=f, a=args[0], b=args[1]: f(a(scope), b(scope))
    if isinstance(node, Choose):
        test, then, other = (_value_closure(n, functions) for n in (node.test, node.then, node.other))
        return lambda scope: then(scope) if test(scope) else other(scope)
    raise TypeError(node)


def _body_closure(nodes: tuple, functions: Mapping[str, Callable], learnt: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_node_closure(n, functions, learnt) for n in nodes]

    def body(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return body


def _node_closure(node: Any, functions: Mapping[str, Callable], learnt: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Text):
        only = ((node.text, learnt),)
        return lambda scope: iter(only)
    if isinstance(node, Print):
        value = _value_closure(node.value, functions)

        def show(scope: dict) -> Iterator[Piece]:
            yield _string(value(scope)), learnt

        return show
    if isinstance(node, Assign):
        value = _value_closure(node.value, functions)

        def assign(scope: dict) -> Iterator[Piece]:
            scope[node.name] = value(scope)
            return iter(())

        return assign
    if isinstance(node, Generation):
        if learnt:
            raise TemplateError("a generation inside a generation")
        return _body_closure(node.body, functions, True)
    if isinstance(node, If):
        test = _value_closure(node.test, functions)
        then, other = _body_closure(node.then, functions, learnt), _body_closure(node.other, functions, learnt)
        return lambda scope: then(scope) if test(scope) else other(scope)
    if isinstance(node, For):
        over, body = _value_closure(node.over, functions), _body_closure(node.body, functions, learnt)

        def loop(scope: dict) -> Iterator[Piece]:
            items = over(scope)
            if isinstance(items, str | Mapping) or not isinstance(items, Iterable):
                raise TemplateError("can't loop over this")
            items = iter(items)
            nothing = object()
            now, n = next(items, nothing), 0
            while now is not nothing:
                # One item ahead, so that loop.last is known.
                after = next(items, nothing)
                inner = dict(scope)
                inner["loop"] = {"index": n + 1, "index0": n, "first": n == 0, "last": after is nothing}
                inner[node.name] = now
                yield from body(inner)
                now, n = after, n + 1

        return loop
    raise TypeError(node)


@dataclass(frozen=True)
class Template:
    """A compiled template; ``render`` gives pieces of text with their generation mark."""

    source: str
    tree: tuple
    _run: Callable[[dict], Iterator[Piece]] = field(repr=False)

    def render(self, **values: Any) -> Iterator[Piece]:
        return self._run(dict(values))

    def text(self, **values: Any) -> str:
        return "".join(t for t, _ in self.render(**values))


def compile_template(source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None) -> Template:
    """Parse, fold and compile.  ``filters`` are added to FILTERS; errors are TemplateError."""
    functions = OPERATORS | {"|" + k: f for k, f in (FILTERS | dict(filters or {})).items()}
    tree = fold(parse(source, filters), functions)
    return Template(source, tree, _body_closure(tree, functions, False))
