"""Reduction policy: how a column is aggregated where no spec says so."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..plans.specs import AggrSpec, HostSpec, parse_aggr, trusted

Spec = str | AggrSpec | HostSpec | Callable

#: Names of type families that may stand as hint keys.
FAMILIES: dict[str, tuple[type, ...]] = {
    "Real": (T.NumericType, T.BooleanType),
    "Number": (T.NumericType, T.BooleanType),
    "Integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType),
    "AbstractFloat": (T.FloatType, T.DoubleType),
    "Bool": (T.BooleanType,),
    "AbstractString": (T.StringType,),
    "String": (T.StringType,),
    "TimeType": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "Date": (T.DateType,),
    "DateTime": (T.TimestampType, T.TimestampNTZType),
    "Vector": (T.ArrayType,),
    "Any": (T.DataType,),
}


def as_spec(spec: Spec) -> AggrSpec | HostSpec:
    """Text is parsed as untrusted; a callable is the host's."""
    if isinstance(spec, str):
        return parse_aggr(spec)
    if isinstance(spec, (AggrSpec, HostSpec)):
        return spec
    if callable(spec):
        return trusted(spec)
    raise TypeError(f"not an aggregation: {spec!r}")


def default_aggr(kind: T.DataType) -> str:
    """Numbers and conditions add up, arrays unite, anything else is its one value."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "sum"
    return "unionall" if isinstance(kind, T.ArrayType) else "uniqvalue"


@dataclass(frozen=True)
class AggrHints:
    """Hints by column name (strings that aren't a type family written ``type:Family``) or by Spark type class; names first, then types in
    the order given, then ``default``."""

    by_name: dict[str, AggrSpec | HostSpec] = field(default_factory=dict)
    by_type: tuple[tuple[tuple[type, ...], AggrSpec | HostSpec], ...] = ()
    default: AggrSpec | HostSpec | None = None

    def resolve(self, name: str, kind: T.DataType) -> AggrSpec | HostSpec:
        if name in self.by_name:
            return self.by_name[name]
        for kinds, spec in self.by_type:
            if isinstance(kind, kinds):
                return spec
        return self.default or parse_aggr(default_aggr(kind))


def hints(rules: dict | list | None = None, default: Spec | None = None) -> AggrHints:
    """Make hints of {key: spec}: a key is a column name, a type family as "type:Real", or a Spark type class."""
    names, kinds = {}, []
    for key, spec in dict(rules or {}).items():
        spec = as_spec(spec)
        if isinstance(key, str) and key.startswith("type:"):
            family = key.removeprefix("type:")
            if family not in FAMILIES:
                raise ValueError(f"type families are {', '.join(FAMILIES)}")
            kinds.append((FAMILIES[family], spec))
        elif isinstance(key, str):
            names[key] = spec
        elif isinstance(key, type) and issubclass(key, T.DataType):
            kinds.append(((key,), spec))
        else:
            raise TypeError(f"a hint's key is a column name or a type, not {key!r}")
    return AggrHints(names, tuple(kinds), as_spec(default) if default is not None else None)
