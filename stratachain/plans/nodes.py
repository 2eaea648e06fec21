"""Syntax tree of a spec."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Node:
    span: tuple[int, int] = field(default=(0, 0), compare=False, kw_only=True)


@dataclass(frozen=True)
class Col(Node):
    name: str


@dataclass(frozen=True)
class Target(Node):
    """The column that an aggregation is for."""


@dataclass(frozen=True)
class Lit(Node):
    value: Any


@dataclass(frozen=True)
class Sym(Node):
    name: str


@dataclass(frozen=True)
class Arr(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Call(Node):
    """``name`` is the registered name, ``spelt`` what was written (an operator, perhaps dotted)."""

    name: str
    args: tuple[Node, ...]
    kwargs: tuple[tuple[str, Node], ...] = ()
    spelt: str = field(default="", compare=False)
    option_spans: tuple[tuple[int, int], ...] = field(default=(), compare=False)


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Grouped(Node):
    """A nested ``inner |> groupby(keys...)``: one value for each combination of keys."""

    inner: Node
    keys: tuple[Node, ...]


@dataclass(frozen=True)
class Pipe(Node):
    """``left |> right`` as parsed; modifiers are peeled off it."""

    left: Node
    right: Node
    spelt: str = field(default="|>", compare=False)


@dataclass(frozen=True)
class Pair(Node):
    """``left => right``, an order entry."""

    left: Node
    right: Node


def children(node: Node) -> tuple[Node, ...]:
    match node:
        case Arr(items):
            return items
        case Call(_, args, kwargs):
            return args + tuple(v for _, v in kwargs)
        case And(a, b) | Or(a, b) | Pipe(a, b) | Pair(a, b):
            return a, b
        case Grouped(inner, keys):
            return inner, *keys
    return ()


def walk(node: Node) -> Iterator[Node]:
    yield node
    for c in children(node):
        yield from walk(c)


def columns(*nodes: Node) -> list[str]:
    """Names of columns in order of first use."""
    return list(dict.fromkeys(n.name for node in nodes for n in walk(node) if isinstance(n, Col)))


#: How tight each infix operator binds; the higher the tighter.
PRECEDENCE = {"^": 90, "*": 70, "/": 70, "∘": 70, "+": 60, "-": 60, "|>": 50, "&&": 30, "||": 20, "=>": 10} | {op: 40 for op in ("==", "!=", "<", "<=", ">", ">=", "≠", "≤", "≥", "in", "∈", "∉")}
UNARY = 80


def text(node: Node, outer: int = 0) -> str:
    """The expression as printed: blanks around infix operators, as few parentheses as can be."""

    def wrap(s: str, own: int) -> str:
        return f"({s})" if own < outer else s

    match node:
        case Col(name):
            return name
        case Target():
            return "_"
        case Lit(value):
            if isinstance(value, bool):
                return "true" if value else "false"
            return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(value, str) else repr(value)
        case Sym(name):
            return f":{name}"
        case Arr(items):
            return f"[{', '.join(map(text, items))}]"
        case And(a, b):
            return wrap(f"{text(a, 30)} && {text(b, 31)}", 30)
        case Or(a, b):
            return wrap(f"{text(a, 20)} || {text(b, 21)}", 20)
        case Pair(a, b):
            return f"{text(a)} => {text(b)}"
        case Pipe(a, b):
            return wrap(f"{text(a, 50)} |> {text(b, 51)}", 50)
        case Grouped(inner, keys):
            return wrap(f"{text(inner, 50)} |> groupby({', '.join(map(text, keys))})", 50)
        case Call(name, args, kwargs):
            op = node.spelt or name
            bare = op.removeprefix(".")
            if bare in PRECEDENCE and len(args) > 1:
                p = PRECEDENCE[bare]
                if op == "*" and node.spelt == "*" and isinstance(args[0], Lit) and node.span == (-1, -1):
                    return wrap(text(args[0]) + text(args[1], p), p)
                parts = [text(a, p if (i == 0) != (bare == "^") else p + 1) for i, a in enumerate(args)]
                return wrap(f"{'' if bare == '^' else ' '}{op}{'' if bare == '^' else ' '}".join(parts), p)
            if bare in ("-", "+", "!") and len(args) == 1:
                return wrap(op + text(args[0], UNARY), UNARY)
            inner = ", ".join(map(text, args))
            more = ", ".join(f"{k} = {text(v)}" for k, v in kwargs)
            return f"{op}({inner}{'; ' if inner and more else ''}{more})" if more and not inner else f"{op}({', '.join(x for x in (inner, more) if x)})"
    raise TypeError(node)
