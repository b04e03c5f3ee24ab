"""A small sandboxed template language for chats, compiled to closures.

Text stands for itself. ``{{ expression }}`` writes a value; ``{% for x in messages %}``, ``{% if %}``, ``{% elif %}``,
``{% else %}``, ``{% set x = expression %}`` and ``{% generation %}`` are blocks, each ended by its ``{% end... %}``.
Expressions are names, ``name.field``, quoted strings, numbers, ``true``, ``false``, ``none``, ``+``, ``==``, ``!=``,
``and``, ``or``, ``not``, parentheses, and ``value | filter``. There are no calls and no attributes: a field is looked up
in a mapping, a filter in a fixed table. Nothing is ever evaluated as Python.

A template is parsed to a tree, constants are folded (operators and filters on constants, conditions that are constant,
neighbouring texts), and the tree becomes closures that append ``(text, under generation)`` to a list.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

Pieces = list[tuple[str, bool]]
Render = Callable[[dict, Pieces, bool], None]
Value = Callable[[dict], object]


class TemplateError(ValueError):
    """The template does not follow the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter by name, with its operands."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def shown(value: object) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else shown(a) + shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "not": lambda a: not a,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: shown(v).strip(),
    "upper": lambda v: shown(v).upper(),
    "lower": lambda v: shown(v).lower(),
    "length": lambda v: len(v),
}

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>\d+)|(?P<string>'[^']*'|\"[^\"]*\")|(?P<op>==|!=|[+|.()=]))")
_LITERALS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.source, self.filters, self.tokens, at = source, filters, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def take(self, *wanted: str) -> str | None:
        if self.tokens and self.tokens[0][0] in ("name", "op") and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def need(self, kind: str) -> str:
        if not self.tokens or self.tokens[0][0] != kind:
            raise TemplateError(f"{kind} expected in {self.source!r}")
        return self.tokens.pop(0)[1]

    def end(self) -> None:
        if self.tokens:
            raise TemplateError(f"{self.tokens[0][1]!r} not expected in {self.source!r}")

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.added()
        op = self.take("==", "!=")
        return Apply(op, (left, self.added())) if op else left

    def added(self):
        left = self.filtered()
        while self.take("+"):
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.primary()
        while self.take("|"):
            name = self.need("name")
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            value = Apply("|" + name, (value,))
        return value

    def primary(self):
        if self.take("("):
            value = self.either()
            if not self.take(")"):
                raise TemplateError(f"unclosed parenthesis in {self.source!r}")
            return value
        if not self.tokens:
            raise TemplateError(f"value expected in {self.source!r}")
        kind, text = self.tokens.pop(0)
        if kind == "string":
            return Const(text[1:-1])
        if kind == "number":
            return Const(int(text))
        if kind != "name":
            raise TemplateError(f"{text!r} not expected in {self.source!r}")
        if text in _LITERALS:
            return Const(_LITERALS[text])
        value = Name(text)
        while self.take("."):
            value = Field(value, self.need("name"))
        return value


def parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    """The tree of a template."""
    parts = [p for p in _TAG.split(source) if p]
    body, stop = _block(parts, filters, ())
    return body


def _block(parts: list[str], filters: Mapping[str, Callable], ends: tuple[str, ...]) -> tuple[tuple, _Expression | None]:
    nodes = []
    while parts:
        part = parts.pop(0)
        if part.startswith("{{"):
            e = _Expression(part[2:-2], filters)
            nodes.append(Write(e.either()))
            e.end()
        elif part.startswith("{%"):
            e = _Expression(part[2:-2], filters)
            word = e.need("name")
            if word in ends:
                e.tokens.insert(0, ("name", word))
                return tuple(nodes), e
            nodes.append(_statement(word, e, parts, filters))
        else:
            nodes.append(Text(part))
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), None


def _statement(word: str, e: _Expression, parts: list[str], filters: Mapping[str, Callable]):
    if word == "set":
        name = e.need("name")
        if not e.take("="):
            raise TemplateError(f"= expected in {e.source!r}")
        node = Set(name, e.either())
        e.end()
        return node
    if word == "for":
        name = e.need("name")
        if not e.take("in"):
            raise TemplateError(f"in expected in {e.source!r}")
        over = e.either()
        e.end()
        body, _ = _block(parts, filters, ("endfor",))
        return For(name, over, body)
    if word == "generation":
        e.end()
        body, _ = _block(parts, filters, ("endgeneration",))
        return Generation(body)
    if word == "if":
        cases, condition = [], e.either()
        e.end()
        while True:
            body, stop = _block(parts, filters, ("elif", "else", "endif"))
            cases.append((condition, body))
            end = stop.need("name")
            condition = stop.either() if end == "elif" else Const(True)
            stop.end()
            if end == "else":
                body, stop = _block(parts, filters, ("endif",))
                cases.append((condition, body))
            if end != "elif":
                return If(tuple(cases))
    raise TemplateError(f"no block {word!r}")


def folded(node, filters: Mapping[str, Callable]):
    """An expression with its constant parts computed."""
    if isinstance(node, Field):
        return Field(folded(node.of, filters), node.name)
    if not isinstance(node, Apply):
        return node
    args = tuple(folded(a, filters) for a in node.args)
    if node.op in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Apply(node.op, args)
    if all(isinstance(a, Const) for a in args):
        return Const(_function(node.op, filters)(*(a.value for a in args)))
    return Apply(node.op, args)


def fold(body: tuple, filters: Mapping[str, Callable]) -> tuple:
    """A body with constants folded, dead branches gone and neighbouring texts joined."""
    out: list = []

    def put(node) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif node != Text(""):
            out.append(node)

    for node in body:
        if isinstance(node, Write):
            value = folded(node.value, filters)
            put(Text(shown(value.value)) if isinstance(value, Const) else Write(value))
        elif isinstance(node, Set):
            put(Set(node.name, folded(node.value, filters)))
        elif isinstance(node, For):
            put(For(node.name, folded(node.over, filters), fold(node.body, filters)))
        elif isinstance(node, Generation):
            put(Generation(fold(node.body, filters)))
        elif isinstance(node, If):
            cases, certain = [], None
            for condition, inner in node.cases:
                condition = folded(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, fold(inner, filters)))
                if isinstance(condition, Const):
                    certain = cases[-1]
                    break
            if certain and len(cases) == 1:
                for inner in certain[1]:
                    put(inner)
            elif cases:
                put(If(tuple(cases)))
        else:
            put(node)
    return tuple(out)


def _function(op: str, filters: Mapping[str, Callable]) -> Callable:
    return filters[op[1:]] if op[0] == "|" else OPERATORS[op]


def value_of(node, filters: Mapping[str, Callable]) -> Value:
    """The closure of an expression."""
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, name=node.name: env.get(name)
    if isinstance(node, Field):
        of = value_of(node.of, filters)

        def field(env: dict, name=node.name):
            held = of(env)
            return held.get(name) if isinstance(held, Mapping) else None

        return field
    args = [value_of(a, filters) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    function = _function(node.op, filters)
    if len(args) == 1:
        return lambda env, a=args[0]: function(a(env))
    return lambda env, a=args[0], b=args[1]: function(a(env), b(env))


def closure(body: tuple, filters: Mapping[str, Callable]) -> Render:
    """The closure of a body."""
    steps = [_step(node, filters) for node in body]

    def run(env: dict, out: Pieces, marked: bool) -> None:
        for step in steps:
            step(env, out, marked)

    return steps[0] if len(steps) == 1 else run


def _step(node, filters: Mapping[str, Callable]) -> Render:
    if isinstance(node, Text):
        return lambda env, out, marked, text=node.text: out.append((text, marked))
    if isinstance(node, Write):
        value = value_of(node.value, filters)
        return lambda env, out, marked: out.append((shown(value(env)), marked))
    if isinstance(node, Set):
        value = value_of(node.value, filters)
        return lambda env, out, marked, name=node.name: env.__setitem__(name, value(env))
    if isinstance(node, Generation):
        inner = closure(node.body, filters)
        return lambda env, out, marked: inner(env, out, True)
    if isinstance(node, If):
        cases = [(value_of(c, filters), closure(b, filters)) for c, b in node.cases]

        def choose(env: dict, out: Pieces, marked: bool) -> None:
            for condition, inner in cases:
                if condition(env):
                    inner(env, out, marked)
                    return

        return choose
    over, inner = value_of(node.over, filters), closure(node.body, filters)

    def repeat(env: dict, out: Pieces, marked: bool, name=node.name) -> None:
        scope = dict(env)
        for item in over(env) or ():
            scope[name] = item
            inner(scope, out, marked)

    return repeat


class Template:
    """A compiled template. ``render`` takes whole conversations; ``head``, ``turn`` and ``tail`` take them turn by turn."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        self.filters = {**FILTERS, **(filters or {})}
        self.tree = fold(parse(source, self.filters), self.filters)
        self._all = closure(self.tree, self.filters)
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, For) and n.over == Name("messages")]
        self.streams = len(loops) == 1 and not any(_assigns(n) for n in self.tree)
        if self.streams:
            at = loops[0]
            self.head, self.tail = (self._part(b) for b in (self.tree[:at], self.tree[at + 1 :]))
            loop = self.tree[at]
            body = closure(loop.body, self.filters)
            self.turn = lambda message: _run(body, {loop.name: message})

    def _part(self, body: tuple) -> Pieces:
        return _run(closure(body, self.filters), {})

    def render(self, messages: list[dict]) -> Pieces:
        return _run(self._all, {"messages": messages})


def _run(render: Render, env: dict) -> Pieces:
    out: Pieces = []
    render(env, out, False)
    return out


def _assigns(node) -> bool:
    """Whether a body sets names, so that a turn may depend on the one before it."""
    if isinstance(node, Set):
        return True
    bodies = [b for _, b in node.cases] if isinstance(node, If) else [getattr(node, "body", ())]
    return reduce(lambda found, body: found or any(map(_assigns, body)), bodies, False)
