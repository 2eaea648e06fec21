"""Specs: parsed (untrusted) text, or what the host gives in Python (trusted)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from ..errors import SpecError
from ..functions import registry
from . import rejections
from .checks import check_aggregation, check_dimension, resolve, shape
from .nodes import And, Call, Col, Lit, Node, Or, Target, columns, walk
from .parser import OrderKey, order_key, parse, peel


@dataclass(frozen=True)
class AggrSpec:
    """An aggregation of one column (``_``), by its source text."""

    source: str
    body: Node = field(compare=False)
    order: tuple[OrderKey, ...] = field(default=(), compare=False)

    @property
    def func(self) -> str:
        return getattr(self.body, "name", type(self.body).__name__.lower())

    @property
    def cols(self) -> list[str]:
        return columns(self.body)


@dataclass(frozen=True)
class DimSpec:
    """A dimension. ``kind``: window (a value for each row in its context) or pivot (a value for each group in it)."""

    source: str
    body: Node = field(compare=False)
    order: tuple[OrderKey, ...] = field(default=(), compare=False)
    by: tuple[Node, ...] | None = field(default=None, compare=False)
    kind: str = field(default="window", compare=False)

    @property
    def func(self) -> str:
        return getattr(self.body, "name", type(self.body).__name__.lower())

    @property
    def cols(self) -> list[str]:
        return columns(self.body, *(self.by or ()))


@dataclass(frozen=True)
class HostSpec:
    """A trusted spec. ``make`` gets the target Column (aggregation), or the ordered Window of the context (dimension), and
    returns a Column: an aggregate, or one over the window."""

    make: Callable[[Any], Any]
    order: tuple[OrderKey, ...] = ()
    by: tuple[Node, ...] | None = None
    kind: str = "window"


def trusted(make: Callable[[Any], Any] | str) -> HostSpec:
    """Mark a callable, or SQL text, as the host's own. Plain text is never trusted."""
    if isinstance(make, str):
        from pyspark.sql import functions as F

        sql = make
        return HostSpec(lambda _: F.expr(sql))
    return HostSpec(make)


_cache: dict[tuple[str, str], AggrSpec | DimSpec] = {}
registry.on_change(_cache.clear)


def _top(node: Node, kind: str) -> None:
    """The form gate: a call or a condition."""
    match node:
        case Call() | And() | Or():
            return
        case Col(name) if kind == "dim":
            raise SpecError(f"'{name}' is a bare column: put it in the chain as a KEY, or write it as a call", "bare_name", name, None, node.span)
        case Target():
            raise SpecError("'_' alone isn't a spec: write it as a call, as in sum(_)", "target_placeholder", "_", None, node.span)
        case Lit():
            raise SpecError("a literal isn't a spec: write it as a call", "invalid_spec", None, None, node.span)
    raise SpecError("a spec is a call or a condition: write it as a call", "invalid_spec", None, None, node.span)


def parse_aggr(source: str, columns: Iterable[str] | None = None) -> AggrSpec:
    """Parse an aggregation spec, such as ``sum(_)``, ``mean(sum(_) |> groupby(year))`` or a bare ``sum``."""
    s = source.strip()
    spec = _cache.get(("aggr", s))
    if spec is None:
        try:
            got = peel(parse(s))
            if got.by is not None:
                raise SpecError("an aggregation takes no groupby at its top: NEST it in a reduction, as in mean(sum(_) |> groupby(key)), or put the column in the chain as a KEY", "modifier_misuse", "groupby")
            body = got.body
            if isinstance(body, Col):
                op = registry.op(body.name)
                if op is None:
                    e = rejections.unknown_op(body.name, body.span)
                    raise SpecError(f"{e.msg}; a bare name in an aggregation is an operator", e.code, e.token, e.fix, e.span)
                if op.shape not in ("reduce", "unknown") or op.least > 1:
                    raise SpecError(f"'{body.name}' alone isn't an aggregation: write it as a call", "bare_name", body.name, None, body.span)
                body = Call(body.name, (Target(span=body.span),), spelt=body.name, span=body.span)
            _top(body, "aggr")
            body = resolve(body)
            check_aggregation(body)
            spec = AggrSpec(s, body, got.order)
        except SpecError as e:
            raise e.within("aggr", s) from None
        _cache["aggr", s] = spec
    if columns is not None:
        check_cols(spec, columns)
    return spec


def parse_dim(source: str, columns: Iterable[str] | None = None) -> DimSpec:
    """Parse a dimension spec, such as ``cumsum(x) |> orderby(t)`` or ``topnames(name, x, 3)``."""
    s = source.strip()
    spec = _cache.get(("dim", s))
    if spec is None:
        try:
            got = peel(parse(s))
            body = got.body
            if isinstance(body, Col) and body.name == "nrow":
                body = Call("nrow", (Lit(1),), spelt="nrow", span=body.span)
            _top(body, "dim")
            for n in walk(body):
                if isinstance(n, Target):
                    raise SpecError("'_' stands for the column of an aggregation; a dimension names its columns", "target_placeholder", "_", None, n.span)
            body = resolve(body)
            by = tuple(resolve(k, True) for k in got.by) if got.by is not None else None
            if by is None and isinstance(body, Call) and (pos := registry.classifier(body.name)) is not None:
                by = (body.args[pos],) if pos < len(body.args) else None
            check_dimension(body, by is not None)
            spec = DimSpec(s, body, got.order, by, "pivot" if by is not None else "window")
        except SpecError as e:
            raise e.within("dim", s) from None
        _cache["dim", s] = spec
    if columns is not None:
        check_cols(spec, columns)
    return spec


def dimspec(spec: str | HostSpec | Callable, by=None, order=None, kind: str = "auto") -> DimSpec | HostSpec:
    """A spec with options from the host; an option that the text gives too is an error."""
    if kind not in ("auto", "window", "pivot"):
        raise ValueError("kind is auto, window or pivot")
    keys = None if by is None else tuple(Col(b) if isinstance(b, str) else b for b in ([by] if isinstance(by, str) else by))
    ordered = () if order is None else tuple(order_key(o) for o in (order if isinstance(order, list) else [order]))
    if isinstance(spec, str):
        spec = parse_dim(spec)
    if callable(spec):
        spec = HostSpec(spec)
    implied = isinstance(spec, DimSpec) and isinstance(spec.body, Call) and registry.classifier(spec.body.name) is not None and "groupby" not in spec.source
    if keys is not None and spec.by is not None and not implied:
        raise SpecError("groupby is given twice: in the spec and as by=", "modifier_misuse", "groupby")
    if ordered and spec.order:
        raise SpecError("orderby is given twice: in the spec and as order=", "modifier_misuse", "orderby")
    by_now = keys if keys is not None else spec.by
    if kind == "window" and keys is not None:
        raise ValueError("a window dimension has no by=")
    if kind == "window":
        by_now = None
    if kind == "pivot" and by_now is None:
        raise ValueError("a pivot dimension needs by=")
    new = {"order": ordered or spec.order, "by": by_now, "kind": "pivot" if by_now is not None else "window"}
    if isinstance(spec, DimSpec):
        check_dimension(spec.body, by_now is not None)
        return DimSpec(spec.source, spec.body, **new)
    return HostSpec(spec.make, **new)


def check_cols(spec: AggrSpec | DimSpec, names: Iterable[str]) -> None:
    """Every column that the spec names is there; an error says where it stands and what it may mean."""
    names = list(names)

    def need(name: str, where: str, span) -> None:
        if name not in names:
            best = rejections.nearest(name, names)
            hint = f" -- did you mean '{best}'?" if best else f". Available columns: {', '.join(names)}"
            raise SpecError(f"the spec references {where}column '{name}', which isn't there{hint}", "unknown_column", name, best, span).within("dim" if isinstance(spec, DimSpec) else "aggr", spec.source)

    by = spec.by if isinstance(spec, DimSpec) else None
    for n in walk(spec.body):
        if isinstance(n, Col):
            need(n.name, "", n.span)
    for k in by or ():
        for n in walk(k):
            if isinstance(n, Col):
                need(n.name, "groupby ", n.span)
    for k in spec.order:
        need(k.column, "orderby ", k.span)


def summary(spec: AggrSpec | DimSpec) -> str:
    """One line on what a spec does."""
    f = fields(spec)
    parts = [f["kind"] + " " + f["func"], "of " + ", ".join(f["cols"]) if f["cols"] else ""]
    parts += ["by " + ", ".join(f["by"])] if f["by"] else []
    parts += ["ordered by " + ", ".join(f["order"])] if f["order"] else []
    return " ".join(p for p in parts if p)


def fields(spec: AggrSpec | DimSpec) -> dict[str, Any]:
    """What a spec consists of, for display."""
    from .nodes import text

    by = spec.by if isinstance(spec, DimSpec) else None
    kind = "aggregation" if isinstance(spec, AggrSpec) else f"{spec.kind} dimension"
    return {"kind": kind, "func": spec.func, "cols": spec.cols, "by": [text(k) for k in by or ()], "order": [f"{k.column}{' desc' if k.desc else ''}" for k in spec.order], "shape": shape(spec.body), "source": spec.source}
