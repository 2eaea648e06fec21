"""The live table of operators: the whitelist of the spec language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: What an operator makes of columns: one value, a value a row, a value from each value, fewer values, or the host doesn't say.
SHAPES = ("reduce", "map", "elementwise", "filter", "unknown")
INFIX = ("+", "-", "*", "/", "^", "==", "!=", "<", "<=", ">", ">=", "≠", "≤", "≥", "!", "in", "∈", "∉")
RESERVED = ("orderby", "groupby")


@dataclass(frozen=True)
class OpDef:
    """``least`` and ``most`` positional arguments (None: any number), keyword options (None: unchecked)."""

    name: str
    shape: str
    least: int = 1
    most: int | None = 1
    kwargs: tuple[str, ...] | None = ()
    host: Callable[..., Any] | None = field(default=None, compare=False)
    doc: str = ""


_ops: dict[str, OpDef] = {}
_classifiers: dict[str, int] = {}
_listeners: list[Callable[[], None]] = []


def _add(names: str, shape: str, least: int = 1, most: int | None = 1, kwargs: tuple[str, ...] | None = (), doc: str = "") -> None:
    for n in names.split():
        _ops[n] = OpDef(n, shape, least, most, kwargs, None, doc)


_add("sum prod mean median std var minimum maximum", "reduce", doc="one number; a missing value makes it missing")
_add("extrema", "reduce", doc="(minimum, maximum)")
_add("length nrow", "reduce", doc="number of rows")
_add("count", "reduce", doc="number of rows where a condition is true")
_add("any all", "reduce", doc="whether a condition is true of any, of all rows")
_add("first last", "reduce", doc="first or last value in order")
_add("quantile", "reduce", 2, 2, doc="quantile(x, p), linear between neighbours")
_add("uniqvalue", "reduce", 1, 1, ("skipna", "skipempty"), "the one distinct value, else missing")
_add("countuniq", "reduce", 1, 1, ("skipna", "skipempty"), "number of distinct values")
_add("unionall", "reduce", doc="distinct elements of all arrays")
_add("isuniform", "reduce", doc="whether all values are equal and none is missing")
_add("strjoinuniq", "reduce", 1, 3, (), "distinct values as one text")
_add("wmeanfallback", "reduce", 2, 2, (), "weighted mean by the first weights with a usable sum")
_add("hhi", "reduce", 1, 1, ("scale", "skipna"), "concentration: the sum of squared shares")
_add("cumsum cumprod", "map", doc="running total or product in order")
_add("lag lead", "map", 1, 2, ("default",), "the value n rows before or after")
_add("rank denserank ordinalrank tiedrank", "map", 1, 1, ("rev",), "rank by value")
_add("topnames", "map", 3, 3, ("absolute", "ranksep", "dense", "tol", "others", "parens"), "labels of the n top groups")
_add("discretize", "map", 1, 2, None, "labels of intervals")
_add("quantiles", "map", 1, 2, ("ngroups", "leftequal", "prefix", "suffix"), "labels of quantile groups")
_add("skipmissing", "filter", doc="drops missing values before a reduction")
_add("where", "elementwise", 1, 1, ("true_label", "false_label"), "labels by a condition")
_add("onlyif", "elementwise", 2, 2, (), "x where a condition is true, else missing")
_add("abs log2 log10 exp sqrt ismissing", "elementwise", doc="of each value")
_add("log", "elementwise", 1, 2, (), "log(x), log(base, x)")
_add("round", "elementwise", 1, 1, ("digits", "sigdigits", "base", "ties"), "of each value; ties go to the even digit, with ties = :away from zero")
_add("floor ceil", "elementwise", 1, 1, ("digits", "sigdigits", "base"), "of each value")
_add("min max coalesce", "elementwise", 1, None, (), "of the arguments, row by row")
_add("yyyy yyyyq yyq", "elementwise", doc="date bucket")
_add("yyyymm yymm", "elementwise", 1, 2, (), "date bucket, with a delimiter")
for _op in INFIX:
    for _name in {_op, "." + _op} if _op not in ("in", "∈", "∉") else {_op}:
        _ops[_name] = OpDef(_name, "elementwise", 1, None if _op in "+-*" else 2, (), None, "operator")
_classifiers["topnames"] = 0
BUILTIN = frozenset(_ops)


def op(name: str) -> OpDef | None:
    return _ops.get(name)


def classifier(name: str) -> int | None:
    """Which argument is the implied grouping column, for classifiers."""
    return _classifiers.get(name)


def list_ops() -> list[str]:
    return sorted(_ops)


def op_shape(name: str) -> str:
    if name not in _ops:
        raise KeyError(f"no operator '{name}'")
    return _ops[name].shape


def on_change(f: Callable[[], None]) -> None:
    _listeners.append(f)


def clear_caches() -> None:
    for f in _listeners:
        f()


def register_op(name: str, host: Callable[..., Any], shape: str = "unknown", least: int = 0, most: int | None = None, kwargs: tuple[str, ...] | None = None, doc: str = "host operator") -> None:
    """Admit a host operator to the language.

    ``host`` maps Columns to a Column. ``reduce``: an aggregate Column (or a GROUPED_AGG pandas UDF); ``elementwise``: a Column of the
    arguments; ``map`` and ``unknown``: called with the ordered window as keyword ``window``.
    """
    if not name.isidentifier() or name in RESERVED:
        raise ValueError(f"'{name}' can't be an operator: a plain name that isn't a modifier, never '.' or '!'")
    if shape not in SHAPES:
        raise ValueError(f"shape is one of {', '.join(SHAPES)}")
    _ops[name] = OpDef(name, shape, least, most, kwargs, host, doc)
    clear_caches()


def register_classifier(name: str, argpos: int = 0) -> None:
    """Make an operator a classifier: its argument ``argpos`` is the grouping column, so its dimension is of pivot kind."""
    if name not in _ops:
        raise ValueError(f"register the operator '{name}' first")
    _classifiers[name] = argpos
    clear_caches()


def unregister(name: str) -> None:
    if name in BUILTIN:
        raise ValueError(f"'{name}' is built in")
    _ops.pop(name, None)
    _classifiers.pop(name, None)
    clear_caches()
