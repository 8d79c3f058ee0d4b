"""A compiler for a small, sandboxed template language: text to syntax tree, constants folded, Python closures made.

    {{ expression }}   {# comment #}   {% set x = expression %}
    {% for m in messages %} ... {% else %} ... {% endfor %}   loop.first, loop.last, loop.index, loop.index0
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   what is inside counts for the loss

A minus sign beside a tag takes the white space on that side away. Expressions have strings, integers, true, false,
none, lists, names, items (a.b and a["b"] of mappings, a[0] of lists), `or and not in == != < <= > >= ~ + -`, `a if c
else b`, `x is defined` and filters. There are no calls, no attributes of Python objects, no multiplication and no
ranges, so a template ends and its output is bounded by its messages. Loops take one item at a time and look one
ahead: messages may be a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

DEEPEST = 40


class TemplateError(ValueError):
    """A fault of a template, found when it is compiled or rendered."""


class Mark:
    """Stands in the output where text that counts for the loss begins or ends."""

    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


START, STOP = Mark("START"), Mark("STOP")


# --- the tree ---

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
class Listing:
    items: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    args: tuple


@dataclass(frozen=True)
class Defined:
    of: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Emit:
    of: Any


@dataclass(frozen=True)
class Assign:
    name: str
    of: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    empty: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- text to tree ---

_TAGS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>==|!=|<=|>=|[-+~<>|.,()\[\]=]))""", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_KEPT = {"or", "and", "not", "in", "is", "if", "else", "defined"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unreadable: {source[at : at + 20]!r}")
        kind, word = m.lastgroup, m[m.lastgroup]
        if kind == "string":
            word = re.sub(r"\\(.)", lambda x: _ESCAPED.get(x[1], x[1]), word[1:-1], flags=re.S)
        out.append((kind, int(word) if kind == "int" else word))
        at = m.end()
    return out


class _Expressions:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _tokens(source), 0, 0

    def next_is(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str | None:
        if self.next_is(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1] in _KEPT | set(_WORDS):
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self, made: Any) -> Any:
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return made

    def expression(self) -> Any:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("nested too deeply")
        out = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            out = Choice(test, out, self.expression())
        self.depth -= 1
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Binary("or", out, self.both())
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Binary("and", out, self.negated())
        return out

    def negated(self) -> Any:
        flips = 0
        while self.take("not"):
            flips += 1
        out = self.compared()
        for _ in range(flips):
            out = Not(out)
        return out

    def compared(self) -> Any:
        out = self.summed()
        while True:
            if self.take("is"):
                no = self.take("not")
                self.need("defined")
                out = Not(Defined(out)) if no else Defined(out)
            elif op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                out = Binary(op, out, self.summed())
            elif self.next_is("not"):
                self.at += 1
                self.need("in")
                out = Not(Binary("in", out, self.summed()))
            else:
                return out

    def summed(self) -> Any:
        out = self.filtered()
        while op := self.take("+", "-", "~"):
            out = Binary(op, out, self.filtered())
        return out

    def filtered(self) -> Any:
        out = Binary("-", Const(0), self.part()) if self.take("-") else self.part()
        while self.take("|"):
            name, args = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.expression())
                    if not self.next_is(")"):
                        self.need(",")
            out = Filter(name, out, tuple(args))
        return out

    def part(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, word = self.tokens[self.at]
        if kind in ("int", "string"):
            self.at += 1
            out: Any = Const(word)
        elif self.take("("):
            out = self.expression()
            self.need(")")
        elif self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if not self.next_is("]"):
                    self.need(",")
            out = Listing(tuple(items))
        elif kind == "name" and word in _WORDS:
            self.at += 1
            out = Const(_WORDS[word])
        else:
            out = Name(self.name())
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.expression())
                self.need("]")
            else:
                return out


class _Statements:
    """Recursive descent over the pieces of a template: text, expressions and tags."""

    def __init__(self, source: str):
        self.pieces: list[tuple[str, str]] = []
        at, bare = 0, False
        for m in _TAGS.finditer(source):
            before, inside, after = next(g for g in (m.groups()[i : i + 3] for i in (0, 3, 6)) if g[1] is not None)
            text = source[at : m.start()]
            text = text.lstrip() if bare else text
            self.pieces += [("text", text.rstrip() if before else text), ({"{": "emit", "%": "tag", "#": "comment"}[m[0][1]], inside)]
            at, bare = m.end(), bool(after)
        self.pieces.append(("text", source[at:].lstrip() if bare else source[at:]))
        self.at, self.depth = 0, 0

    def until(self, *ends: str) -> tuple[tuple, str, _Expressions | None]:
        """The statements up to one of the tags, that tag's word and what follows it."""
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("nested too deeply")
        out: list[Any] = []
        while self.at < len(self.pieces):
            kind, body = self.pieces[self.at]
            self.at += 1
            if kind == "text" and body:
                out.append(Emit(Const(body)))
            elif kind == "emit":
                e = _Expressions(body)
                out.append(Emit(e.end(e.expression())))
            elif kind == "tag":
                e = _Expressions(body)
                word = e.take("for", "if", "set", "generation", *ends)
                if word is None:
                    raise TemplateError(f"tag {body.strip()!r} has no place here")
                if word in ends:
                    self.depth -= 1
                    return tuple(out), word, e
                out.append(self.statement(word, e))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), "", None

    def statement(self, word: str, e: _Expressions) -> Any:
        if word == "set":
            name = e.name()
            e.need("=")
            return Assign(name, e.end(e.expression()))
        if word == "generation":
            e.end(None)
            body, _, last = self.until("endgeneration")
            return last.end(Generation(body))
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.end(e.expression())
            body, word, last = self.until("else", "endfor")
            last.end(None)
            empty: tuple = ()
            if word == "else":
                empty, _, last = self.until("endfor")
                last.end(None)
            return For(name, over, body, empty)
        test = e.end(e.expression())
        then, word, last = self.until("elif", "else", "endif")
        if word == "elif":
            return If(test, then, (self.statement("if", last),))
        last.end(None)
        other: tuple = ()
        if word == "else":
            other, _, last = self.until("endif")
            last.end(None)
        return If(test, then, other)


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    body, _, _ = _Statements(source).until()
    return body


# --- values ---

class _Undefined:
    """What a name or an item that isn't there gives; only `is defined` and default() take it."""


UNDEFINED = _Undefined()


def _known(x: Any) -> Any:
    if x is UNDEFINED:
        raise TemplateError("a value is not defined")
    return x


def _text(x: Any) -> str:
    if isinstance(x, str):
        return x
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    raise TemplateError(f"{type(x).__name__} can't be printed")


def _guard(x: Any) -> str:
    return guard(_text(x))


#: Strings with a meaning in the formatted text. None stands in a guarded text.
HEADER, END = "### ", "</turn>"


def guard(text: str) -> str:
    """A text without control strings: a backslash goes before each backslash, between two number signs and before the
    slash of an end mark. unguard() takes them away again."""
    return re.sub("#(?=#)", r"#\\", text.replace("\\", "\\\\").replace(END, "<\\/turn>"))


def guard_line(text: str) -> str:
    """As guard(), on one line: a line break gets a backslash before it."""
    return guard(text).replace("\n", "\\\n")


def unguard(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {
    "guard": _guard,
    "guard_line": lambda x: guard_line(_text(x)),
    "trim": lambda x: _text(x).strip(" \t\n\r\x0b\x0c"),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "string": _text,
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple)) else _bad("length"),
    "default": lambda x, other="": other if x is UNDEFINED or x is None else x,
}


def _bad(what: str) -> Any:
    raise TemplateError(f"{what}: not of such a value")


def _add(a: Any, b: Any) -> Any:
    if (type(a), type(b)) in ((int, int), (str, str)):
        return a + b
    return _bad("+")


def _subtract(a: Any, b: Any) -> Any:
    return a - b if (type(a), type(b)) == (int, int) else _bad("-")


def _ordered(compare: Callable) -> Callable:
    return lambda a, b: compare(a, b) if type(a) is type(b) and isinstance(a, (int, str)) else _bad("order")


def _inside(a: Any, b: Any) -> bool:
    return a in b if isinstance(b, (list, tuple, Mapping)) or isinstance(a, str) and isinstance(b, str) else _bad("in")


OPERATORS: dict[str, Callable] = {
    "+": _add, "-": _subtract, "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": _inside,
    "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
}


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping) and isinstance(key, str):
        return of.get(key, UNDEFINED)
    if isinstance(of, (list, tuple)) and type(key) is int:
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    return _bad("item")


# --- folding ---

def fold(node: Any) -> Any:
    """The tree with what is constant worked out: expressions of constants, branches that are never or always taken,
    neighbouring texts. What would fail stays, to fail when it is reached."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.of, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].of, Const):
                    out[-1] = Emit(Const(out[-1].of.value + y.of.value))
                elif not (isinstance(y, Emit) and y.of == Const("")):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Item):
        return _worked(Item(fold(node.of), fold(node.key)), ("of", "key"), _item)
    if isinstance(node, Listing):
        items = tuple(map(fold, node.items))
        return Const([x.value for x in items]) if all(isinstance(x, Const) for x in items) else Listing(items)
    if isinstance(node, Filter):
        of, args = fold(node.of), tuple(map(fold, node.args))
        if all(isinstance(x, Const) for x in (of, *args)):
            try:
                return Const(FILTERS[node.name](of.value, *[x.value for x in args]))
            except (TemplateError, TypeError):
                pass
        return Filter(node.name, of, args)
    if isinstance(node, Not):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Defined):
        of = fold(node.of)
        return Const(True) if isinstance(of, Const) else Defined(of)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if node.op in ("and", "or"):
            if isinstance(left, Const):
                return right if bool(left.value) == (node.op == "and") else left
            return Binary(node.op, left, right)
        return _worked(Binary(node.op, left, right), ("left", "right"), OPERATORS[node.op])
    if isinstance(node, Choice):
        test = fold(node.test)
        return fold(node.then if test.value else node.other) if isinstance(test, Const) else Choice(test, fold(node.then), fold(node.other))
    if isinstance(node, Emit):
        of = fold(node.of)
        return Emit(Const(_text(of.value))) if isinstance(of, Const) and not isinstance(of.value, list) else Emit(of)
    if isinstance(node, Assign):
        return replace(node, of=fold(node.of))
    if isinstance(node, If):
        test = fold(node.test)
        return fold(node.then if test.value else node.other) if isinstance(test, Const) else If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        over = fold(node.over)
        return fold(node.empty) if over == Const([]) else For(node.name, over, fold(node.body), fold(node.empty))
    if isinstance(node, Generation):
        body = fold(node.body)
        return Generation(body) if body else ()
    return node


def _worked(node: Any, parts: tuple[str, str], work: Callable) -> Any:
    a, b = (getattr(node, p) for p in parts)
    if isinstance(a, Const) and isinstance(b, Const):
        try:
            got = work(a.value, b.value)
            return node if got is UNDEFINED else Const(got)
        except TemplateError:
            pass
    return node


# --- closures ---

def _value(node: Any) -> Callable[[dict], Any]:
    """The closure of an expression: scope to value."""
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name, UNDEFINED)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda scope: _item(_known(of(scope)), _known(key(scope)))
    if isinstance(node, Listing):
        items = [_value(x) for x in node.items]
        return lambda scope: [_known(f(scope)) for f in items]
    if isinstance(node, Filter):
        work, of, args = FILTERS[node.name], _value(node.of), [_value(x) for x in node.args]
        if node.name == "default":
            return lambda scope: work(of(scope), *[_known(f(scope)) for f in args])
        if args:
            raise TemplateError(f"filter {node.name} takes no arguments")
        return lambda scope: work(_known(of(scope)))
    if isinstance(node, Defined):
        of = _value(node.of)
        return lambda scope: of(scope) is not UNDEFINED
    if isinstance(node, Not):
        of = _value(node.of)
        return lambda scope: not _known(of(scope))
    if isinstance(node, Binary):
        left, right = _value(node.left), _value(node.right)
        if node.op == "and":
            return lambda scope: _known(left(scope)) and _known(right(scope))
        if node.op == "or":
            return lambda scope: _known(left(scope)) or _known(right(scope))
        work = OPERATORS[node.op]
        return lambda scope: work(_known(left(scope)), _known(right(scope)))
    test, then, other = _value(node.test), _value(node.then), _value(node.other)
    return lambda scope: then(scope) if _known(test(scope)) else other(scope)


Render = Callable[[dict], Iterator[Any]]


def _body(nodes: tuple) -> Render:
    runs = [_run(x) for x in nodes]

    def run(scope: dict) -> Iterator[Any]:
        for r in runs:
            yield from r(scope)

    return runs[0] if len(runs) == 1 else run


def _run(node: Any) -> Render:
    """The closure of a statement: scope to its pieces of text and marks, one by one."""
    if isinstance(node, Emit):
        of = _value(node.of)

        def emit(scope: dict) -> Iterator[Any]:
            yield _text(_known(of(scope)))

        return emit
    if isinstance(node, Assign):
        name, of = node.name, _value(node.of)

        def assign(scope: dict) -> Iterator[Any]:
            scope[name] = _known(of(scope))
            return iter(())

        return assign
    if isinstance(node, If):
        test, then, other = _value(node.test), _body(node.then), _body(node.other)
        return lambda scope: then(scope) if _known(test(scope)) else other(scope)
    if isinstance(node, Generation):
        inside = _body(node.body)

        def generation(scope: dict) -> Iterator[Any]:
            yield START
            yield from inside(scope)
            yield STOP

        return generation
    name, over, body, empty = node.name, _value(node.over), _body(node.body), _body(node.empty)

    def loop(scope: dict) -> Iterator[Any]:
        items = _known(over(scope))
        if not isinstance(items, (list, tuple, Iterator)):
            raise TemplateError("a loop takes a list or the messages")
        items, i, nothing = iter(items), 0, object()
        item = next(items, nothing)
        if item is nothing:
            yield from empty(scope)
        while item is not nothing:
            after = next(items, nothing)
            yield from body(scope | {name: item, "loop": {"first": i == 0, "last": after is nothing, "index": i + 1, "index0": i}})
            item, i = after, i + 1

    return loop


def compile_template(source: str) -> Render:
    """A function that renders a scope (a dict; `messages` may be an iterator of mappings) piece by piece, with START
    and STOP around what counts for the loss. Raises TemplateError for a faulty template."""
    tree = fold(parse(source))
    _no_nested(tree, False)
    return _body(tree)


def _no_nested(nodes: tuple, inside: bool) -> None:
    for x in nodes:
        if isinstance(x, Generation):
            if inside:
                raise TemplateError("generation inside generation")
            _no_nested(x.body, True)
        elif isinstance(x, If):
            _no_nested(x.then, inside)
            _no_nested(x.other, inside)
        elif isinstance(x, For):
            _no_nested(x.body, inside)
            _no_nested(x.empty, inside)
