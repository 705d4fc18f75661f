"""Chat formatting with a small sandboxed template language, compiled to Python closures.

    {{ value }}  {% for x in values %} ... {% endfor %}  {% if value %} ... {% elif value %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}

Values are names, fields (``x.role``), texts in quotes, whole numbers, ``true`` and ``false``, compared with ``==`` and ``!=``,
put together with ``~``, joined with ``and``, ``or``, ``not`` and passed through the filters given to the compiler
(``x | guard``). There is nothing else: no calls, no assignments, no attributes of Python objects. Text between generation
marks is what a model learns from.

A template is parsed into a tree, constant parts are folded, and each node becomes a closure that yields (text, learned)
pieces. Messages may be any iterable: a conversation is rendered while it is read, one message ahead for ``loop.last``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

TOKEN = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
WORD = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[().|~]))""")
KEYWORDS = ("and", "or", "not", "true", "false")
ESCAPES = {"n": "\n", "t": "\t"}

Scope = dict[str, object]
Value = Callable[[Scope], object]
Pieces = Callable[[Scope], Iterator[tuple[str, bool]]]
Filter = Callable[[str], str]


class TemplateError(ValueError):
    """A template that is not of the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Apply:
    """An operator or filter over its operands."""

    op: str
    of: tuple


@dataclass(frozen=True)
class Put:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    cases: tuple  # (test, body) pairs; the test of an else is Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


class _Values:
    """Recursive descent over one value; weakest first: or, and, not, comparison, ~, filters."""

    def __init__(self, source: str, filters: dict[str, Filter]):
        self.filters, self.words, at = filters, [], 0
        source = source.strip()
        while at < len(source):
            found = WORD.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.words.append(found)
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at][0].strip() if self.at < len(self.words) else None

    def take(self, *wanted: str) -> str | None:
        if (word := self.peek()) in wanted:
            self.at += 1
            return word
        return None

    def whole(self) -> object:
        value = self.chain("or", lambda: self.chain("and", self.negated))
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return value

    def chain(self, op: str, part: Callable[[], object]) -> object:
        value = part()
        while self.take(op):
            value = Apply(op, (value, part()))
        return value

    def negated(self) -> object:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> object:
        value = self.chain("~", self.filtered)
        while op := self.take("==", "!="):
            value = Apply(op, (value, self.chain("~", self.filtered)))
        return value

    def filtered(self) -> object:
        value = self.single()
        while self.take("|"):
            name = self.peek()
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            value = Apply("|" + name, (value,))
        return value

    def single(self) -> object:
        if self.take("("):
            value = self.chain("or", lambda: self.chain("and", self.negated))
            if not self.take(")"):
                raise TemplateError("missing )")
            return value
        if self.peek() is None:
            raise TemplateError("missing value")
        quoted, number, name, _ = self.words[self.at].groups()
        self.at += 1
        if quoted is not None:
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), quoted[1:-1], flags=re.DOTALL))
        if number is not None:
            return Const(int(number))
        if name in ("true", "false"):
            return Const(name == "true")
        if name is None or name in KEYWORDS:
            raise TemplateError(f"unexpected {self.words[self.at - 1][0]!r}")
        path = [name]
        while self.take("."):
            field = self.words[self.at][3] if self.at < len(self.words) else None
            if field is None:
                raise TemplateError("missing field name")
            self.at += 1
            path.append(field)
        return Name(tuple(path))


def parse(template: str, filters: dict[str, Filter]) -> tuple:
    """The tree of a template."""
    value = lambda source: _Values(source, filters).whole()
    root: list = []
    stack: list[tuple[str, object, list]] = [("", None, root)]
    at = 0
    for found in TOKEN.finditer(template):
        body = stack[-1][2]
        if found.start() > at:
            body.append(Put(Const(template[at : found.start()])))
        at = found.end()
        if found[1] is not None:
            body.append(Put(value(found[1])))
            continue
        word, _, rest = found[2].strip().partition(" ")
        kind, head, _ = stack[-1]
        if word == "for":
            if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
                raise TemplateError(f"can't read for {rest!r}")
            stack.append(("for", (m[1], value(m[2])), []))
        elif word == "if":
            stack.append(("if", [(value(rest), [])], []))
            stack[-1] = ("if", stack[-1][1], stack[-1][1][0][1])
        elif word in ("elif", "else") and kind == "if":
            head.append((value(rest) if word == "elif" else Const(True), []))
            stack[-1] = ("if", head, head[-1][1])
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word == "end" + kind and kind:
            stack.pop()
            done = (
                For(*head, tuple(body)) if kind == "for"
                else If(tuple((test, tuple(part)) for test, part in head)) if kind == "if"
                else Generation(tuple(body))
            )
            stack[-1][2].append(done)
        else:
            raise TemplateError(f"unexpected {found[0]!r}")
    if len(stack) > 1:
        raise TemplateError(f"missing end{stack[-1][0]}")
    if at < len(template):
        root.append(Put(Const(template[at:])))
    return tuple(root)


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: _text(a) + _text(b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def _operator(op: str, filters: dict[str, Filter]) -> Callable:
    return (lambda a: filters[op[1:]](_text(a))) if op[0] == "|" else OPERATORS[op]


def fold(node: object, filters: dict[str, Filter]) -> object:
    """The same node with constant values worked out."""
    if isinstance(node, Apply):
        of = tuple(fold(x, filters) for x in node.of)
        if all(isinstance(x, Const) for x in of):
            return Const(_operator(node.op, filters)(*(x.value for x in of)))
        return Apply(node.op, of)
    return node


def fold_all(nodes: Iterable, filters: dict[str, Filter]) -> tuple:
    """Constant values worked out, decided branches taken, neighbouring texts put together."""
    out: list = []
    for node in nodes:
        if isinstance(node, Put):
            new = [Put(fold(node.value, filters))]
        elif isinstance(node, For):
            new = [For(node.name, fold(node.over, filters), fold_all(node.body, filters))]
        elif isinstance(node, Generation):
            new = [Generation(fold_all(node.body, filters))]
        else:
            cases = []
            for test, body in ((fold(t, filters), fold_all(b, filters)) for t, b in node.cases):
                if not isinstance(test, Const) or test.value:
                    cases.append((test, body))
                if isinstance(test, Const) and test.value:
                    break
            new = list(cases[0][1]) if cases and isinstance(cases[0][0], Const) else [If(tuple(cases))] if cases else []
        for node in new:
            constant = isinstance(node, Put) and isinstance(node.value, Const)
            if constant and not (said := _text(node.value.value)):
                continue
            if constant and out and isinstance(out[-1], Put) and isinstance(out[-1].value, Const):
                out[-1] = Put(Const(out[-1].value.value + said))
            else:
                out.append(Put(Const(said)) if constant else node)
    return tuple(out)


def _value(node: object, filters: dict[str, Filter]) -> Value:
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):
        first, *fields = node.path

        def look(scope: Scope) -> object:
            found = scope.get(first)
            for field in fields:
                found = found.get(field) if isinstance(found, dict) else None
            return found

        return look
    fn, of = _operator(node.op, filters), [_value(x, filters) for x in node.of]
    if len(of) == 1:
        return lambda scope: fn(of[0](scope))
    return lambda scope: fn(of[0](scope), of[1](scope))


def _ahead(values: Iterable) -> Iterator[tuple[object, dict]]:
    """Each value with the loop's variables; holds one value ahead."""
    rest = iter(values)
    value, number, end = next(rest, _ahead), 0, _ahead
    while value is not end:
        following = next(rest, end)
        yield value, {"index": number, "first": number == 0, "last": following is end}
        value, number = following, number + 1


def _pieces(nodes: tuple, filters: dict[str, Filter], learned: bool) -> Pieces:
    parts = [_piece(node, filters, learned) for node in nodes]

    def render(scope: Scope) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(scope)

    return render


def _piece(node: object, filters: dict[str, Filter], learned: bool) -> Pieces:
    if isinstance(node, Put):
        value = _value(node.value, filters)
        return lambda scope: iter([(_text(value(scope)), learned)])
    if isinstance(node, Generation):
        return _pieces(node.body, filters, True)
    if isinstance(node, For):
        over, body = _value(node.over, filters), _pieces(node.body, filters, learned)

        def repeat(scope: Scope) -> Iterator[tuple[str, bool]]:
            for value, loop in _ahead(over(scope) or ()):
                yield from body(scope | {node.name: value, "loop": loop})

        return repeat
    cases = [(_value(test, filters), _pieces(body, filters, learned)) for test, body in node.cases]

    def choose(scope: Scope) -> Iterator[tuple[str, bool]]:
        for test, body in cases:
            if test(scope):
                return body(scope)
        return iter(())

    return choose


def compile_template(template: str, filters: dict[str, Filter] | None = None) -> Pieces:
    """A function of a scope that yields (text, learned) pieces."""
    filters = filters or {}
    return _pieces(fold_all(parse(template, filters), filters), filters, False)


def guard(controls: tuple[str, ...]) -> Filter:
    """A filter that puts a backslash before each control string and each backslash of a text."""
    pattern = re.compile("|".join(map(re.escape, sorted({"\\", *controls}, key=len, reverse=True))))
    return lambda text: pattern.sub(lambda m: "\\" + m[0], text)


def unguard(text: str) -> str:
    """The text that was guarded."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)
