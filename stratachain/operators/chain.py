"""The two verbs. ``dim`` adds columns, each partitioned by everything to its left in the chain; ``agg`` reduces to the chain's keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions import registry
from ..plans.lower import Lowerer, Plain, c, needs_rows, temp
from ..plans.nodes import Call, Col, Node, columns, walk
from ..plans.specs import AggrSpec, DimSpec, HostSpec, check_cols, dimspec, parse_dim, trusted
from .hints import AggrHints, as_spec, hints

Entry = str | tuple


@dataclass(frozen=True)
class Dimension:
    """A chain entry that makes a column ``name`` in the context of ``left``."""

    name: str
    spec: DimSpec | HostSpec
    left: tuple[str, ...] = ()


def _spec(spec) -> DimSpec | HostSpec:
    if isinstance(spec, str):
        return parse_dim(spec)
    if isinstance(spec, (DimSpec, HostSpec)):
        return spec
    if callable(spec):
        return trusted(spec)
    raise TypeError(f"not a dimension: {spec!r}")


def normalize(chain) -> tuple[list[str], list[Dimension]]:
    """Keys of the chain in order, and its dimensions with their left contexts."""
    if isinstance(chain, (str, Dimension)) or isinstance(chain, tuple) and len(chain) == 2 and isinstance(chain[0], str) and not (isinstance(chain[1], tuple) and len(chain[1]) == 2):
        chain = [chain]
    keys: list[str] = []
    dims: list[Dimension] = []
    for e in chain:
        if isinstance(e, str):
            name = e
        elif isinstance(e, Dimension):
            name = e.name
            dims.append(e if e.left else Dimension(e.name, e.spec, tuple(keys)))
        elif isinstance(e, (tuple, list)) and len(e) == 2 and isinstance(e[0], str):
            name = e[0]
            dims.append(Dimension(name, _spec(e[1]), tuple(keys)))
        else:
            raise TypeError(f"a chain entry is a column name, a (name, spec) pair or a Dimension, not {e!r}")
        if name in keys:
            raise ValueError(f"'{name}' stands in the chain twice")
        keys.append(name)
    return keys, dims


def _sensitive(spec) -> bool:
    """Whether rows must be numbered as they come."""
    if isinstance(spec, HostSpec):
        return bool(spec.order) or spec.kind == "pivot"
    by = spec.by if isinstance(spec, DimSpec) else None
    return needs_rows(spec.body, *(by or ()))


def _stable(d: Dimension, plain: Plain, df: DataFrame, h: AggrHints) -> bool:
    """Whether each reading of the chain's frame gives the dimension the same values: it depends on no order of rows and on nothing of the host's."""
    if not isinstance(d.spec, DimSpec) or _sensitive(d.spec) or d.spec.order:
        return False
    nodes = [d.spec.body, *(d.spec.by or ())]
    if d.spec.kind == "pivot":
        read = [_hinted(df, h, n) for n in columns(d.spec.body)]
        if any(not isinstance(s, AggrSpec) or needs_rows(s.body) for s in read):
            return False
        nodes += [s.body for s in read]
    own = all(registry.op(n.name).host is None for x in nodes for n in walk(x) if isinstance(n, Call))
    return own and plain.stable.issuperset([*d.left, *columns(*nodes)])


def _hinted(df: DataFrame, h: AggrHints, name: str):
    return h.resolve(name, df.schema[name].dataType)


def _numbered(df: DataFrame) -> tuple[DataFrame, str]:
    row = temp("row")
    return df.withColumn(row, F.monotonically_increasing_id()), row


def _measured(df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, AggrSpec | HostSpec, str]], row: str | None, plain: Plain | None = None) -> tuple[DataFrame, list[Column]]:
    """The frame with what the measures need staged, and the aggregate Column of each."""
    low = Lowerer(df, keys, row=row, plain=plain)
    out = []
    for source, spec, name in wanted:
        if isinstance(spec, HostSpec):
            col = spec.make(c(source))
        else:
            low.target = source
            low.env = type(low.env)(low.env.parts, tuple(spec.order))
            col = low.aggregate(spec.body)
        out.append(col.alias(name))
    low.flush()
    return low.df, out


def _window(df: DataFrame, d: Dimension, row: str | None, plain: Plain) -> DataFrame:
    if isinstance(d.spec, HostSpec):
        w = Window.partitionBy(*map(c, d.left))
        low = Lowerer(df, d.left, order=d.spec.order, row=row)
        return df.withColumn(d.name, d.spec.make(w.orderBy(*low.sort(low.env)) if d.spec.order else w))
    low = Lowerer(df, d.left, order=d.spec.order, row=row, plain=plain)
    col = low.dimension(d.spec.body)
    return low.df.withColumn(d.name, col)


def _pivot(df: DataFrame, d: Dimension, h: AggrHints, row: str | None) -> DataFrame:
    """Group within the context, aggregate what the spec reads by hints, run it over the groups, and give each row its group's value."""
    spec = d.spec
    known: dict[Node, str] = {}
    keys: list[str] = []
    for k in spec.by:
        if isinstance(k, Col):
            name = k.name
        else:
            low = Lowerer(df, d.left, row=row)
            col = low.dimension(k)
            name = temp("k")
            df = low.df.withColumn(name, col)
            known[k] = name
        if name not in keys:
            keys.append(name)
    group = list(dict.fromkeys([*d.left, *keys]))
    bodies = [] if isinstance(spec, HostSpec) else [spec.body]
    reads = _reads(bodies, known)
    needed = [n for n in dict.fromkeys([*reads, *(k.column for k in spec.order)]) if n not in group]
    wanted = [(n, _hinted(df, h, n), n) for n in needed]

    staged, cols = _measured(df, group, wanted, row)
    first = temp("first")
    grouped = staged.groupBy(*map(c, group)).agg(*cols, *([F.min(c(row)).alias(first)] if row else [F.lit(0).alias(first)]))
    low = Lowerer(grouped, d.left, order=spec.order, row=first if row else None, known=known)
    if isinstance(spec, HostSpec):
        col = spec.make(Window.partitionBy(*map(c, d.left)).orderBy(*low.sort(low.env)))
    else:
        col = low.dimension(spec.body)
    names = [temp("j") for _ in group]
    value = low.df.select(*(c(g).alias(n) for g, n in zip(group, names, strict=True)), col.alias(d.name))
    base = df.drop(d.name) if d.name in df.columns else df
    on = reduce(lambda a, b: a & b, (c(g).eqNullSafe(c(n)) for g, n in zip(group, names, strict=True)))
    return base.join(value, on, "left").drop(*names)


def _reads(bodies: Sequence[Node], known: dict[Node, str]) -> list[str]:
    """Columns that are read outside computed keys."""
    from ..plans.nodes import children

    out: list[str] = []

    def visit(n: Node) -> None:
        if n in known:
            return
        if isinstance(n, Col):
            out.append(n.name)
        for x in children(n):
            visit(x)

    for b in bodies:
        visit(b)
    return list(dict.fromkeys(out))


def _apply(df: DataFrame, dims: Sequence[Dimension], h: AggrHints, replace: bool, row: str | None, plain: Plain) -> DataFrame:
    order = list(df.columns)
    for d in dims:
        have = [n for n in df.columns if n != row]
        for k in d.left:
            if k not in have:
                raise SpecError(f"dimension '{d.name}': its context column '{k}' isn't there. Available columns: {', '.join(have)}", "unknown_column", k)
        if d.name in have and not replace:
            raise ValueError(f"the frame already has a column '{d.name}': replace=True overwrites it")
        if isinstance(d.spec, DimSpec):
            check_cols(d.spec, have)
        else:
            for n in [k.column for k in d.spec.order] + columns(*(d.spec.by or ())):
                if n not in have:
                    raise SpecError(f"dimension '{d.name}' references column '{n}', which isn't there", "unknown_column", n)
        stable = _stable(d, plain, df, h)
        if d.spec.kind == "pivot":
            df = _pivot(df, d, h, row)
            plain.reads *= 2
        else:
            df = _window(df, d, row, plain)
        stable = stable and not isinstance(df.schema[d.name].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
        plain.put(d.name, stable, stable and isinstance(d.spec.body, Call) and d.spec.body.name in ("topnames", "quantiles"))
        if d.name not in order:
            order.append(d.name)
        df = df.select(*map(c, order))
    return df


def _as_hints(h) -> AggrHints:
    return h if isinstance(h, AggrHints) else hints(h)


def dim(df: DataFrame, *chains, hints: AggrHints | dict | None = None, replace: bool = False) -> DataFrame:
    """``df`` with the dimensions that the chains declare, in order; rows and other columns stay.

    >>> dim(orders, ["o_orderstatus", ("share", "o_totalprice / sum(o_totalprice)")])
    """
    if len(chains) == 1 and isinstance(chains[0], list) and not chains[0]:
        raise ValueError("the chain declares no dimension")
    plans = [normalize(ch) for ch in chains]
    for _, dims in plans:
        if not dims:
            raise ValueError("the chain declares no dimension: a key alone adds nothing")
    h, row = _as_hints(hints), None
    if any(_sensitive(d.spec) for _, dims in plans for d in dims):
        df, row = _numbered(df)
    plain = Plain(df)
    for _, dims in plans:
        df = _apply(df, dims, h, replace, row, plain)
    return df.drop(row) if row else df


def measures(df: DataFrame, keys: Sequence[str], cols, allbut, h: AggrHints) -> list[tuple[str, AggrSpec | HostSpec, str]]:
    """(source, spec, output name) of each measure."""
    if cols is not None and allbut is not None:
        raise ValueError("cols and allbut are mutually exclusive")
    if allbut is not None:
        allbut = [allbut] if isinstance(allbut, str) else list(allbut)
        for n in allbut:
            if n in keys:
                raise ValueError(f"allbut: '{n}' is a key")
            if n not in df.columns:
                raise SpecError(f"allbut: column '{n}' isn't there. Available columns: {', '.join(df.columns)}", "unknown_column", n)
    if cols is None:
        cols = [n for n in df.columns if n not in keys and n not in (allbut or ())]
    out = []
    for e in [cols] if isinstance(cols, (str, tuple)) else cols:
        e = (e,) if isinstance(e, str) else e
        source, spec, name = (*e, None, None)[:3] if len(e) < 3 else e
        name = name or source
        if source not in df.columns:
            raise SpecError(f"measure '{source}': no such column. Available columns: {', '.join(df.columns)}", "unknown_column", source)
        if name in keys:
            raise ValueError(f"measure '{name}' has the name of a key")
        if any(name == n for _, _, n in out):
            raise ValueError(f"two measures are named '{name}'")
        spec = _hinted(df, h, source) if spec is None else as_spec(spec)
        if isinstance(spec, AggrSpec):
            check_cols(spec, df.columns)
        out.append((source, spec, name))
    return out


def agg(df: DataFrame, chain, hints: AggrHints | dict | None = None, cols=None, allbut=None) -> DataFrame:
    """One row for each combination of the chain's keys: the keys, then the measures.

    ``cols``: "column", ("column", spec) or ("column", spec, "name") entries; without it all columns but the keys (and but ``allbut``),
    each by its hint.
    """
    keys, dims = normalize(chain)
    h, row = _as_hints(hints), None
    plain = list(df.columns)
    if any(_sensitive(d.spec) for d in dims):
        df, row = _numbered(df)
    given = Plain(df)
    if dims:
        df = _apply(df, dims, h, False, row, given)
    for k in keys:
        if k not in df.columns:
            raise SpecError(f"key '{k}' isn't there. Available columns: {', '.join(plain)}", "unknown_column", k)
    wanted = measures(df.drop(row) if row else df, keys, cols, allbut, h)
    if not wanted:
        return df.select(*map(c, keys)).distinct()
    if row is None and any(_sensitive(s) for _, s, _ in wanted if isinstance(s, AggrSpec)):
        df, row = _numbered(df)
    staged, out = _measured(df, keys, wanted, row, given)
    return staged.groupBy(*map(c, keys)).agg(*out)


class Transform:
    """A verb with its options, to be applied to frames later; ``a @ b`` applies b first."""

    def __init__(self, f: Callable[[DataFrame], DataFrame], name: str = "transform"):
        self.f, self.name = f, name

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.f(df)

    def __matmul__(self, other: Callable[[DataFrame], DataFrame]) -> Transform:
        return Transform(lambda df: self(other(df)), f"{self.name} @ {getattr(other, 'name', 'transform')}")

    def __repr__(self) -> str:
        return f"<{self.name}>"


def dims(*chains, **options) -> Transform:
    """``dim`` as a transform: ``df.transform(dims(chain))``."""
    return Transform(lambda df: dim(df, *chains, **options), "dims")


def aggs(chain, **options) -> Transform:
    """``agg`` as a transform."""
    return Transform(lambda df: agg(df, chain, **options), "aggs")


__all__ = ["Dimension", "Transform", "agg", "aggs", "dim", "dims", "dimspec", "measures", "normalize"]
