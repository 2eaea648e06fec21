"""From syntax tree to Spark Columns.

A spec is lowered against a frame, the columns that partition it (the left context, or the keys of an aggregation) and an order.
Reductions of the frame's own columns become aggregates of a ``groupBy`` by the partition, combined map-side, and joined back null-safe;
the aggregation reads the frame that the verb was given, so a chain's plan grows with its length only. In a context that the chain has
computed they read the chain's frame a second time, within a bound, and quantiles are selected by counting, so that no task holds a context's rows.
Other reductions of what a chain has computed are aggregates over windows. Those over the whole frame are one row, broadcast. In an aggregation the outermost ones become
aggregates of its own ``groupBy``. A reduction of nested groups is two aggregations, by partition and groups and then by partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions import registry
from ..functions.labels import Style, interval_labels, quantile_labels
from .nodes import And, Arr, Call, Col, Grouped, Lit, Node, Or, Sym, Target, columns, text, walk
from .parser import OrderKey

_numbers = count()
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
INF, NAN = float("inf"), float("nan")
#: How often a chain's frame may read the verb's.
READS = 24
#: Operators whose result depends on the order of rows.
ORDERED = {"cumsum", "cumprod", "lag", "lead", "first", "last", "ordinalrank"}


def c(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def temp(what: str = "v") -> str:
    return f"__{what}_{next(_numbers)}"


def groupings(node: Node) -> list[Grouped] | None:
    """The nested groupings that an expression is made of; None where it reads anything else than these and literals."""
    match node:
        case Grouped():
            return [node]
        case Lit() | Sym():
            return []
        case And(a, b) | Or(a, b):
            inner = [a, b]
        case Arr(items):
            inner = items
        case Call(name, args) if (op := registry.op(name)) and op.host is None and op.shape in ("elementwise", "filter", "map") and name not in ("in", "∉", "∈", "topnames"):
            inner = args
        case _:
            return None
    found = [groupings(x) for x in inner]
    return None if None in found else [g for f in found for g in f]


def needs_rows(*nodes: Node) -> bool:
    """Whether a spec depends on the order in which rows come."""
    for node in nodes:
        for n in walk(node):
            if isinstance(n, Grouped) or isinstance(n, Call) and (n.name in ORDERED or (op := registry.op(n.name)) and op.host and op.shape in ("map", "unknown")):
                return True
    return False


class Windowed:
    """Makes aggregates values over a window of the partition."""

    def __init__(self, parts: Sequence[Column]):
        self.window = Window.partitionBy(*parts)

    def __call__(self, a: Column) -> Column:
        return a.over(self.window)


class Keyed:
    """Makes aggregates values that are joined to the partition's rows later. ``computed``: they read the frame of the chain."""

    def __init__(self, low: Lowerer, env: Env, computed: bool):
        self.low, self.env, self.computed = low, env, computed

    def __call__(self, a: Column) -> Column:
        name = temp("g")
        self.low.pending.setdefault((self.computed, *map(str, self.env.parts)), (self.env.parts, []))[1].append((name, a))
        return c(name)

    def selected(self, y: Column, ps: Sequence[float]) -> Column:
        name = temp("g")
        self.low.selections.append((self.env.parts, y, tuple(ps), name))
        return c(name)


@dataclass(frozen=True)
class Val:
    """Lowered values. ``flag``: the rows that stand for one value each of a collection, in ``order``; ``skip``: missing ones are dropped;
    ``window``: has a window or a pending whole-frame value inside."""

    col: Column
    flag: Column | None = None
    order: tuple[Column, ...] = ()
    skip: bool = False
    window: bool = False

    @property
    def masked(self) -> Column:
        return self.col if self.flag is None else F.when(self.flag, self.col)


class Plain:
    """A frame as a verb was given it, and the names of its columns that still mean the same. ``stable``: columns that are the same in
    each reading of the chain's frame and no real numbers, which as keys make small contexts; ``few``: those of them with few values;
    ``reads``: how often the chain's frame reads the verb's."""

    def __init__(self, df: DataFrame):
        self.df, self.names = df, set(df.columns)
        self.stable, self.few, self.reads = set(df.columns), set(), 1

    def put(self, name: str, stable: bool, few: bool) -> None:
        """The chain has computed column ``name``."""
        self.names.discard(name)
        for names, on in ((self.stable, stable), (self.few, stable and few)):
            (names.add if on else names.discard)(name)


@dataclass(frozen=True)
class Env:
    parts: tuple[Column, ...]
    order: tuple[OrderKey, ...] = ()
    final: bool = False


class Lowerer:
    def __init__(self, df: DataFrame, keys: Sequence[str], target: str | None = None, order: Sequence[OrderKey] = (), row: str | None = None, known: dict[Node, str] | None = None, plain: Plain | None = None):
        self.df, self.target, self.row, self.plain = df, target, row, plain
        self.start, self.start_reads = df, plain.reads if plain else 1
        self.keys = tuple(keys)
        self.env = Env(tuple(c(k) for k in keys), tuple(order))
        self.known = known or {}
        self.pending: dict[Any, tuple[tuple[Column, ...], list[tuple[str, Column]]]] = {}
        self.selections: list[tuple[tuple[Column, ...], Column, tuple[float, ...], str]] = []  # quantiles to be selected
        self.groups: dict[tuple, Any] = {}  # nested groupings that are staged already
        self.nested: dict[tuple, tuple[Env, tuple[Node, ...], list[tuple[str, Call]]]] = {}  # reductions of nested groups by grouping

    # -- frame

    def stage(self, col: Column, what: str = "v") -> Column:
        self.flush()
        name = temp(what)
        self.df = self.df.withColumn(name, col)
        return c(name)

    def flush(self) -> None:
        """Compute pending aggregates, in one pass for each partitioning, and give each row those of its partition."""
        base, waiting, self.pending = self.df, self.pending, {}
        for (computed, *_), (parts, aggs) in waiting.items():
            names = [temp("j") for _ in parts]
            cols = [col.alias(name) for name, col in aggs]
            frame = self.start if computed else self.plain.df if parts else base
            self.attach(parts, names, self.small(computed, frame.groupBy(*(p.alias(n) for p, n in zip(parts, names, strict=True))).agg(*cols)))
            self.read(self.start_reads if computed else 1)
        selections, self.selections = self.selections, []
        for parts, y, ps, name in selections:
            names = [temp("j") for _ in parts]
            self.attach(parts, names, self.small(True, self.select_quantiles(parts, names, y, ps, name)))
            self.read(3 * self.start_reads)
        grouped, self.nested = self.nested, {}
        for (target, _), (env, keys, found) in grouped.items():
            self.reduce_groups(target, env, keys, found)

    def attach(self, parts: Sequence[Column], names: Sequence[str], values: DataFrame, *more: Column) -> None:
        """Join ``values``, a row for each combination of ``names``, to the rows of the parts; without parts it is one row."""
        if not parts and not more:
            self.df = self.df.crossJoin(F.broadcast(values))
            return
        on = reduce(lambda a, b: a & b, [*(p.eqNullSafe(c(n)) for p, n in zip(parts, names, strict=True)), *more])
        self.df = self.df.join(values, on, "left").drop(*names)

    def read(self, more: int) -> None:
        if self.plain is not None:
            self.plain.reads += more

    def small(self, computed: bool, values: DataFrame) -> DataFrame:
        """Values by context; broadcast where all keys are labels of a few classes."""
        return F.broadcast(values) if computed and self.plain.few.issuperset(self.keys) else values

    def select_quantiles(self, parts: Sequence[Column], names: Sequence[str], y: Column, ps: Sequence[float], out: str) -> DataFrame:
        """Quantiles of the partitions as ``percentile`` has them, found by counting: values are counted by classes of their logarithm, those of
        the classes that hold a wanted rank by equal steps between the class's bounds, and only those of the steps that hold one by value."""
        b, n, lo, hi, before, total = (temp(w) for w in ("b", "n", "lo", "hi", "before", "total"))
        x, step, count, value = temp("x"), temp("s"), temp("n"), temp("v")
        rows = self.start.select(*(p.alias(k) for p, k in zip(parts, names, strict=True)), y.cast("double").alias(x)).where(c(x).isNotNull())
        size = F.floor(64 * F.log2(F.abs(c(x)))).cast("long") + 100_000
        wide = F.when(c(x) == 0, F.lit(0)).when(F.isnan(c(x)), F.lit(1_000_000)).when(c(x) == INF, F.lit(900_000)).when(c(x) == -INF, F.lit(-900_000)).when(c(x) > 0, size).otherwise(-size)
        rows = rows.withColumn(b, wide.cast("long"))
        at = [(F.lit(float(p)) * (c(total) - 1)).cast("double") for p in ps]
        ranks = [r for a in at for r in (F.floor(a) + 1, F.ceil(a) + 1)]

        def placed(counts: DataFrame, by: Sequence[str], key: str, much: str, *given: Column) -> DataFrame:
            """Rows up to each key's own, and whether a wanted rank lies in it."""
            run = F.sum(c(much)).over(Window.partitionBy(*map(c, by)).orderBy(c(key)).rowsBetween(Window.unboundedPreceding, 0))
            more = [] if given else [F.sum(c(much)).over(Window.partitionBy(*map(c, by))).alias(total)]
            end = temp("end")
            found = counts.select("*", *more, (run + (given[0] if given else 0)).alias(end))
            held = reduce(lambda a, b: a | b, ((r > c(end) - c(much)) & (r <= c(end)) for r in ranks))
            return found.where(held).withColumn(before if not given else before + "_", c(end) - c(much)).drop(end, much)

        def joined(frame: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
            other = {k: temp("j") for k in keys}
            found = self.small(True, found.withColumnsRenamed(other))
            return frame.join(found, reduce(lambda a, b: a & b, (c(k).eqNullSafe(c(o)) for k, o in other.items()))).drop(*other.values())

        keys = [*names, b]
        wanted = placed(rows.groupBy(*map(c, keys)).agg(F.count(F.lit(1)).alias(n), F.min(c(x)).alias(lo), F.max(c(x)).alias(hi)), names, b, n)
        near = joined(rows, wanted, keys)
        share = F.when(c(hi) > c(lo), F.floor((c(x) - c(lo)) / (c(hi) - c(lo)) * 262_144).cast("long")).otherwise(F.lit(0).cast("long"))
        near = near.withColumn(step, share)
        steps = near.groupBy(*map(c, keys), c(step)).agg(F.count(F.lit(1)).alias(count), F.first(c(total)).alias(total), F.first(c(before)).alias(before))
        fine = placed(steps, keys, step, count, c(before)).select(*map(c, keys), c(step), c(before + "_").alias(value))
        last = joined(near, fine, [*keys, step]).groupBy(*map(c, keys), c(step), c(x)).agg(F.count(F.lit(1)).alias(count), F.first(c(total)).alias(total), F.first(c(value)).alias(value))
        run = F.sum(c(count)).over(Window.partitionBy(*map(c, keys), c(step)).orderBy(c(x)).rowsBetween(Window.unboundedPreceding, 0))
        end = temp("end")
        last = last.withColumn(end, c(value) + run)
        ends = [F.max(F.when((r > c(end) - c(count)) & (r <= c(end)), c(x))) for r in ranks]
        tops = [temp("q") for _ in ends]
        found = last.groupBy(*map(c, names)).agg(*(e.alias(q) for e, q in zip(ends, tops, strict=True)), F.first(c(total)).alias(total))
        between = [F.when(c(q) == c(r), c(q)).otherwise((F.ceil(a) - a) * c(q) + (a - F.floor(a)) * c(r)) for a, q, r in zip(at, tops[::2], tops[1::2], strict=True)]
        return found.select(*map(c, names), F.array(*between).alias(out))

    def quantiles_of(self, over: Callable[[Column], Column], y: Column, ps: Sequence[float]) -> Column:
        """An array of quantiles."""
        return over.selected(y, ps) if isinstance(over, Keyed) and over.computed else over(F.percentile(y, F.array(*map(F.lit, ps))))

    def dtype(self, col: Column) -> T.DataType:
        self.flush()
        return self.df.select(col.alias("x")).schema[0].dataType

    def over(self, env: Env, plain: bool = False, stable: bool = False) -> Callable[[Column], Column]:
        """How an aggregate Column becomes a value here; ``plain``: it reads nothing but columns of the verb's frame; ``stable``: nothing
        but columns of the chain's that are the same in each reading."""
        if env.final:
            return lambda a: a
        if env.parts and not plain and not stable:
            return Windowed(env.parts)
        return Keyed(self, env, bool(env.parts) and not plain)

    def reads_stable(self, env: Env, *nodes: Node, times: int = 1) -> bool:
        """Whether the context is computed and may be read again: it and the nodes are made of stable columns, and the plan stays within a bound."""
        if self.plain is None or self.row is not None or self.plain.names.issuperset(self.keys) or self.plain.reads + times * self.start_reads > READS:
            return False
        names = self.plain.names
        self.plain.names = self.plain.stable
        try:
            return self.reads_plain(env, *nodes)
        finally:
            self.plain.names = names

    def reads_plain(self, env: Env, *nodes: Node) -> bool:
        """Whether nodes, partition and order are made of columns of the verb's frame, without other reductions."""
        if self.plain is None or len(env.parts) != len(self.keys):
            return False
        inside = [n for x in nodes for n in walk(x)]
        names = {*self.keys, *columns(*nodes), *(k.column for k in env.order)} | ({self.target} if any(isinstance(n, Target) for n in inside) else set())
        if self.row is not None and needs_rows(*nodes):
            names.add(self.row)
        scalar = all(not isinstance(n, Grouped) and n not in self.known and (not isinstance(n, Call) or (op := registry.op(n.name)).host is None and op.shape in ("elementwise", "filter")) for n in inside)
        return scalar and names <= self.plain.names

    def sort(self, env: Env) -> list[Column]:
        """Sort keys: missing last ascending, first descending; ties by row."""
        keys = [c(k.column).desc_nulls_first() if k.desc else c(k.column).asc_nulls_last() for k in env.order]
        return [*keys, c(self.row)] if self.row else keys or [F.lit(1)]

    def window(self, env: Env, v: Val | None = None):
        if v is not None and v.flag is not None:
            return Window.partitionBy(*env.parts, v.flag).orderBy(*(o.asc() for o in v.order))
        return Window.partitionBy(*env.parts).orderBy(*self.sort(env))

    # -- values

    def value(self, node: Node, env: Env | None = None) -> Val:
        env = env or self.env
        if node in self.known:
            return Val(c(self.known[node]))
        match node:
            case Col(name):
                return Val(c(name))
            case Target():
                return Val(c(self.target))
            case Lit(v):
                return Val(F.lit(v))
            case Sym(name):
                return Val(F.lit(name))
            case Arr(items):
                vals = [self.value(i, env) for i in items]
                return self.joined(vals, F.array(*(v.col for v in vals)))
            case And(a, b):
                x, y = self.value(a, env), self.value(b, env)
                return self.joined([x, y], x.col & y.col)
            case Or(a, b):
                x, y = self.value(a, env), self.value(b, env)
                return self.joined([x, y], x.col | y.col)
            case Grouped(inner, keys):
                return self.grouped(inner, keys, env)
            case Call(name):
                op = registry.op(name)
                if op.host is not None:
                    return self.hosted(op, node, env)
                if op.shape == "reduce":
                    return self.reduce(node, env)
                if op.shape == "filter":
                    return replace(self.value(node.args[0], env), skip=True)
                if op.shape == "map":
                    return self.mapped(node, env)
                return self.elementwise(node, env)
        raise SpecError(f"can't lower {text(node)}")

    @staticmethod
    def joined(vals: Sequence[Val], col: Column) -> Val:
        """Values of one shape combined row by row."""
        flags = [v for v in vals if v.flag is not None]
        if len({str(v.flag) for v in flags}) > 1:
            raise SpecError("collections of different groupings can't be combined value by value", "shape")
        lead = flags[0] if flags else Val(col)
        return Val(col, lead.flag, lead.order, any(v.skip for v in vals), any(v.window for v in vals))

    def grouped(self, inner: Node, keys: tuple[Node, ...], env: Env) -> Val:
        """One value for each combination of ``keys`` within the partition, on its first row."""
        seen = (inner, keys, self.target, env.order, tuple(map(str, env.parts)))
        if seen not in self.groups:
            self.groups[seen] = self._grouped(inner, keys, env)
        return self.groups[seen]

    def _grouped(self, inner: Node, keys: tuple[Node, ...], env: Env) -> Val:
        cols = []
        for k in keys:
            v = self.value(k, replace(env, final=False))
            cols.append(self.stage(v.col, "k") if v.window else v.col)
        deep = Env(env.parts + tuple(cols), env.order)
        v = self.value(inner, deep)
        first = F.row_number().over(Window.partitionBy(*deep.parts).orderBy(c(self.row) if self.row else F.lit(1))) == 1
        order = tuple(x for k in cols for x in (k.isNull(), k))
        return Val(self.stage(v.col), self.stage(first, "f"), order, False, False)

    def two_phase(self, node: Call, env: Env) -> Column | None:
        """A reduction that reads nothing but nested groups: aggregated by partition and groups, then by partition; None for any other."""
        found = groupings(node.args[0]) if node.args else None
        if not found or any(g in self.known for g in found) or len({g.keys for g in found}) > 1:
            return None
        by = found[0].keys
        if not env.final and env.parts and not (self.reads_plain(env, *by) and all(self.plain_reduction(g.inner, env) for g in found)):
            return None
        at = (by, env.order, tuple(map(str, env.parts)))
        seen = ("reduce", node, self.target, at)
        if seen not in self.groups:
            self.groups[seen] = temp("g")
            self.nested.setdefault((self.target, at), (env, by, []))[2].append((self.groups[seen], node))
        value = c(self.groups[seen])
        return F.first(value) if env.final else value

    def plain_reduction(self, node: Node, env: Env) -> bool:
        """An expression of reductions of the verb's columns."""
        if isinstance(node, Call) and (op := registry.op(node.name)) and op.host is None and op.shape == "reduce":
            return self.reads_plain(env, *node.args) and not (self.row and self.row not in self.plain.names and needs_rows(node))
        return isinstance(node, (Lit, Sym)) or isinstance(node, Call) and op.host is None and op.shape == "elementwise" and all(self.plain_reduction(a, env) for a in node.args)

    def reduce_groups(self, target: str | None, env: Env, keys: tuple[Node, ...], found: Sequence[tuple[str, Call]]) -> None:
        """Reductions of groups by ``keys``: aggregated by partition and keys, then by partition, for all at once."""
        inner = {g: None for _, node in found for g in groupings(node.args[0])}
        plain = not env.final and bool(env.parts)
        low = Lowerer(self.plain.df if plain else self.df, self.keys, target, (), self.row, self.known, self.plain)
        by = []
        for k in keys:
            v = low.value(k, replace(env, final=False))
            by.append(low.stage(v.col, "k") if v.window else v.col)
        for g in inner:
            inner[g] = low.value(g.inner, Env((*env.parts, *by), env.order, True)).col
        low.flush()
        parts, names, made = [temp("j") for _ in env.parts], [temp("k") for _ in by], {g: temp() for g in inner}
        groups = low.df.groupBy(*(p.alias(n) for p, n in zip((*env.parts, *by), (*parts, *names), strict=True))).agg(*(col.alias(made[g]) for g, col in inner.items()))
        high = Lowerer(groups, parts, known=made)
        deep = Env(tuple(map(c, parts)), tuple(OrderKey(k, False) for k in names), True)
        outer = [high.value(node, deep).col.alias(name) for name, node in found]
        high.flush()
        self.attach(env.parts, parts, high.df.groupBy(*map(c, parts)).agg(*outer))

    def settled(self, v: Val, env: Env) -> Val:
        """``v`` fit for an aggregate: windows and what other aggregates have made are staged."""
        if v.window:
            return replace(v, col=self.stage(v.col), flag=None if v.flag is None else self.stage(v.flag, "f"), window=False)
        return v

    def number(self, col: Column) -> tuple[Column, T.DataType]:
        kind = self.dtype(col)
        return (col.cast("long"), T.LongType()) if isinstance(kind, T.BooleanType) else (col, kind)

    # -- reductions

    def reduce(self, node: Call, env: Env) -> Val:
        kw = {k: self.constant(v) for k, v in node.kwargs}
        inner = replace(env, final=False)
        if node.name == "wmeanfallback":
            return Val(self.wmeanfallback(node, env), window=not env.final)
        if (made := self.two_phase(node, env)) is not None:
            return Val(made, window=not env.final)
        v = self.settled(self.value(node.args[0], inner), env) if node.args else Val(F.lit(1))
        over = self.over(env, self.reads_plain(env, *node.args) and not (node.name in ("first", "last") and (env.order or self.row and self.row not in self.plain.names)), node.name not in ("first", "last") and self.reads_stable(env, *node.args, times=4 if node.name in ("median", "quantile") else 1))
        rest = [self.constant(a) for a in node.args[1:]]
        col = getattr(self, "r_" + node.name)(v, over, env, *rest, **kw)
        return Val(col, window=not env.final)

    def rows(self, v: Val) -> Column:
        return F.count(F.lit(1)) if v.flag is None else F.count(F.when(v.flag, 1))

    def np(self, v: Val, over, agg: Column, empty: Any = None) -> Column:
        """An aggregate that a missing value makes missing. Skipped ones don't; then ``empty`` stands for no value at all."""
        if v.skip:
            return over(agg) if empty is None else F.coalesce(over(agg), F.lit(empty))
        return F.when(over(self.rows(v)) == over(F.count(v.masked)), over(agg))

    def r_sum(self, v, over, env):
        x, _ = self.number(v.col)
        v = replace(v, col=x)
        return self.np(v, over, F.sum(v.masked), 0)

    def r_prod(self, v, over, env):
        x, kind = self.number(v.col)
        v = replace(v, col=x)
        out = self.np(v, over, F.product(v.masked), 1)
        return self.exact(out, "prod", self.np(v, over, F.min(F.abs(v.masked)), 1) == 0) if isinstance(kind, INTEGRAL) else out

    def exact(self, x: Column, who: str, zero: Column) -> Column:
        """A whole number computed as a real one: an error where that can't be exact. A factor of zero makes it zero, whatever the others."""
        error = F.raise_error(F.lit(f"{who}: the product of whole numbers is beyond 2^53; make them real numbers for a rounded one"))
        return F.when(zero, F.lit(0).cast("long")).when(F.abs(x) <= 2.0**53, x.cast("long")).when(x.isNotNull(), error.cast("long"))

    def r_mean(self, v, over, env):
        v = replace(v, col=self.number(v.col)[0])
        return self.np(v, over, F.avg(v.masked), NAN)

    def r_median(self, v, over, env):
        v = replace(v, col=self.number(v.col)[0])
        if isinstance(over, Keyed) and over.computed:
            return self.np(v, lambda a: a if a is middle else over(a), middle := over.selected(v.masked, [0.5])[0])
        return self.np(v, over, F.median(v.masked))

    def spread(self, v, over, agg):
        v = replace(v, col=self.number(v.col)[0])
        alone = self.np(v, over, F.max(F.when(v.masked.isNotNull(), F.lit(NAN))))
        return F.when(over(F.count(v.masked)) == 1, alone).otherwise(self.np(v, over, agg(v.masked)))

    def r_std(self, v, over, env):
        return self.spread(v, over, F.stddev_samp)

    def r_var(self, v, over, env):
        return self.spread(v, over, F.var_samp)

    def r_quantile(self, v, over, env, p):
        v = replace(v, col=self.number(v.col)[0])
        if isinstance(over, Keyed) and over.computed:
            found = over.selected(v.masked, [float(x) for x in p] if isinstance(p, list) else [float(p)])
            found = found if isinstance(p, list) else found[0]
            return self.np(v, lambda a: a if a is found else over(a), found)
        q = F.array(*map(F.lit, map(float, p))) if isinstance(p, list) else F.lit(float(p))
        return self.np(v, over, F.percentile(v.masked, q))

    def r_minimum(self, v, over, env):
        return self.np(v, over, F.min(v.masked))

    def r_maximum(self, v, over, env):
        return self.np(v, over, F.max(v.masked))

    def r_extrema(self, v, over, env):
        return F.struct(self.r_minimum(v, over, env).alias("min"), self.r_maximum(v, over, env).alias("max"))

    def r_length(self, v, over, env):
        return over(F.count(v.masked) if v.skip else self.rows(v))

    r_nrow = r_length

    def r_count(self, v, over, env):
        return self.np(v, over, F.count_if(v.masked))

    def r_any(self, v, over, env):
        x = v.masked
        good = F.coalesce(over(F.bool_or(x)), F.lit(False))
        return good if v.skip else F.when(good, True).when(over(self.rows(v)) > over(F.count(x)), F.lit(None).cast("boolean")).otherwise(False)

    def r_all(self, v, over, env):
        x = v.masked
        good = F.coalesce(over(F.bool_and(x)), F.lit(True))
        return good if v.skip else F.when(~good, False).when(over(self.rows(v)) > over(F.count(x)), F.lit(None).cast("boolean")).otherwise(True)

    def _end(self, v: Val, over, env: Env, last: bool) -> Column:
        """First or last value in order: by the least or greatest sort key, which needs no sort; one that runs both ways is ranked first."""
        if v.flag is not None:
            key = F.struct(*v.order)
        elif any(k.desc for k in env.order):
            key = self.stage(F.row_number().over(Window.partitionBy(*env.parts).orderBy(*self.sort(env))), "o")
        else:
            key = F.struct(*(x for k in env.order for x in (c(k.column).isNull(), c(k.column))), c(self.row) if self.row else F.lit(1))
        on = v.flag if v.flag is not None else F.lit(True)
        if v.skip:
            on = on & v.col.isNotNull()
        return over((F.max_by if last else F.min_by)(v.col, F.when(on, key)))

    def r_first(self, v, over, env):
        return self._end(v, over, env, False)

    def r_last(self, v, over, env):
        return self._end(v, over, env, True)

    def _blanked(self, v: Val, skipempty: bool) -> Val:
        return replace(v, col=F.when(v.col.cast("string") != "", v.col)) if skipempty and isinstance(self.dtype(v.col), T.StringType) else v

    def r_uniqvalue(self, v, over, env, skipna=True, skipempty=False):
        v = self._blanked(v, skipempty)
        x = v.masked
        out = F.when(over(F.min(x)).eqNullSafe(over(F.max(x))), over(F.min(x)))
        return out if skipna else F.when(over(self.rows(v)) == over(F.count(x)), out)

    def r_countuniq(self, v, over, env, skipna=True, skipempty=False):
        v = self._blanked(v, skipempty)
        x = v.masked
        n = F.size(over(F.collect_set(x))) if isinstance(over, Windowed) else over(F.count_distinct(x))
        out = n if skipna else n + (over(self.rows(v)) > over(F.count(x))).cast("int")
        return out.cast("long")

    def r_unionall(self, v, over, env):
        sets = over(F.collect_set(v.masked))
        return F.array_sort(F.array_distinct(F.filter(F.flatten(sets), lambda e: e.isNotNull())))

    def r_isuniform(self, v, over, env):
        x = v.masked
        return F.coalesce((over(self.rows(v)) == over(F.count(x))) & (over(F.min(x)) == over(F.max(x))), F.lit(False))

    def r_strjoinuniq(self, v, over, env, sep=",", limit=128):
        s = F.array_join(F.array_sort(over(F.collect_set(v.masked.cast("string")))), sep)
        return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 1)), F.lit("…"))).otherwise(s)

    def r_hhi(self, v, over, env, scale=1, skipna=True):
        x = replace(v, col=self.number(v.col)[0].cast("double")).masked
        total = over(F.sum(x))
        ok = (over(F.min(x)) >= 0) & (total > 0)
        if not skipna:
            ok = ok & (over(self.rows(v)) == over(F.count(x)))
        return F.when(ok, F.lit(float(scale)) * over(F.sum(x * x)) / (total * total))

    def wmeanfallback(self, node: Call, env: Env) -> Column:
        weights = node.args[1].items if isinstance(node.args[1], Arr) else (node.args[1],)
        if not weights:
            raise SpecError("wmeanfallback: give at least one weight", "invalid_spec")
        inner = replace(env, final=False)
        vals = [self.value(node.args[0], inner), *(self.value(w, inner) for w in weights)]
        x, *ws = [self.settled(v, env) for v in vals]
        over = self.over(env)
        xs = self.number(x.col)[0].cast("double")
        cases = None
        for w in ws:
            flag = x.flag if x.flag is not None else w.flag
            wv = Val(self.number(w.col)[0].cast("double"), flag, skip=w.skip)
            total = self.np(wv, over, F.sum(wv.masked))
            both = Val(xs * wv.col, flag, skip=x.skip)
            mean = self.np(both, over, F.sum(both.masked)) / total
            cases = F.when(total.isNotNull() & (total != 0), mean) if cases is None else cases.when(total.isNotNull() & (total != 0), mean)
        return cases

    # -- maps

    def mapped(self, node: Call, env: Env) -> Val:
        kw = {k: self.constant(v) for k, v in node.kwargs}
        name = node.name
        if name == "topnames":
            return self.topnames(node, env, **kw)
        v = self.settled(self.value(node.args[0], env), replace(env, parts=env.parts or (F.lit(0),), final=False))
        self.reading_plain = self.reads_plain(env, node.args[0])
        self.reading_stable = self.reads_stable(env, node.args[0], times=3)
        if name in ("discretize", "quantiles"):
            breaks = node.args[1] if len(node.args) > 1 else None
            col = getattr(self, name)(v, breaks, env, **kw)
        else:
            w = self.window(env, v)
            col = getattr(self, "m_" + name)(v, w, env, *(self.constant(a) for a in node.args[1:]), **kw)
        return replace(v, col=col, window=True)

    def _running(self, v, w, agg):
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        out = agg.over(w)
        return out if v.skip else F.when(F.max(v.col.isNull().cast("int")).over(w) == 0, out)

    def m_cumsum(self, v, w, env):
        x, _ = self.number(v.col)
        return self._running(replace(v, col=x), w, F.sum(x))

    def m_cumprod(self, v, w, env):
        x, kind = self.number(v.col)
        v = replace(v, col=x)
        out = self._running(v, w, F.product(x))
        return self.exact(out, "cumprod", self._running(v, w, F.min(F.abs(x))) == 0) if isinstance(kind, INTEGRAL) else out

    def m_lag(self, v, w, env, n=1, default=None):
        f = F.lag if n >= 0 else F.lead
        moved = f(F.struct(v.col.alias("x")), abs(n)).over(w)
        fill = F.lit(default) if default is None else F.lit(default).cast(self.dtype(v.col))
        return F.when(moved.isNull(), fill).otherwise(moved["x"]) if default is not None else moved["x"]

    def m_lead(self, v, w, env, n=1, default=None):
        return self.m_lag(v, w, env, -n, default)

    def _by_value(self, v: Val, env: Env, rev: bool, *more: Column):
        parts = env.parts if v.flag is None else (*env.parts, v.flag)
        return Window.partitionBy(*parts).orderBy(v.col.desc_nulls_last() if rev else v.col.asc_nulls_last(), *more), parts

    def m_rank(self, v, w, env, rev=False):
        return F.when(v.col.isNotNull(), F.rank().over(self._by_value(v, env, rev)[0]).cast("long"))

    def m_denserank(self, v, w, env, rev=False):
        return F.when(v.col.isNotNull(), F.dense_rank().over(self._by_value(v, env, rev)[0]).cast("long"))

    def m_ordinalrank(self, v, w, env, rev=False):
        ties = [o.asc() for o in v.order] if v.flag is not None else self.sort(env)
        return F.when(v.col.isNotNull(), F.row_number().over(self._by_value(v, env, rev, *ties)[0]).cast("long"))

    def m_tiedrank(self, v, w, env, rev=False):
        by, parts = self._by_value(v, env, rev)
        return F.when(v.col.isNotNull(), F.rank().over(by) + (F.count(F.lit(1)).over(Window.partitionBy(*parts, v.col)) - 1) / F.lit(2.0))

    # -- classifiers

    def discretize(self, v: Val, breaks: Node | None, env: Env, boundedness="unbounded", bucketstrs=None, leftequal=True, absolute=False, rank=True, ranksep=". ", label="", compact=None, reverse=False, quantiles=None, ngroups=None, **style) -> Column:
        x, kind = self.number(v.col)
        if absolute:
            x = F.abs(x)
        look = {"leftequal": leftequal, "absolute": absolute, "rank": rank, "ranksep": ranksep, "label": label, "compact": compact, "reverse": reverse, "style": Style(**style)}
        if breaks is None:
            inner = [float(q) for q in quantiles if 0 < q < 1] if quantiles is not None else [i / (ngroups or 4) for i in range(1, ngroups or 4)]
            names = list(bucketstrs or interval_labels([0.0, *sorted(inner), 1.0], False, "bounded", **look))
            return self._by_quantiles(v, x, sorted(inner), names, leftequal, env, self.reading_plain)
        if quantiles is not None or ngroups is not None:
            raise SpecError("discretize: breaks and quantiles or ngroups are mutually exclusive", "invalid_spec")
        items = breaks.items if isinstance(breaks, Arr) else (breaks,)
        if not all(isinstance(i, Lit) for i in items):
            return self._by_moving(x, items, env, boundedness, bucketstrs, look)
        b = sorted(i.value for i in items)
        if not b:
            raise SpecError("discretize: give at least one break", "invalid_spec")
        integral = isinstance(kind, INTEGRAL) and all(isinstance(i, int) for i in b)
        names = list(bucketstrs or interval_labels(b, integral, boundedness, **look))
        below, above = boundedness in ("unbounded", "boundedabove"), boundedness in ("unbounded", "boundedbelow")
        if len(names) != len(b) - 1 + below + above:
            raise SpecError(f"discretize: {len(b) - 1 + below + above} labels are needed, got {len(names)}", "invalid_spec")
        out = F.when(x.isNull(), None)
        out = out.when(x < b[0] if leftequal or not below else x <= b[0], names.pop(0) if below else None)
        for i, hi in enumerate(b[1:], 1):
            closed = not leftequal or (i == len(b) - 1 and not above)
            out = out.when(x <= hi if closed else x < hi, names.pop(0))
        return out.otherwise(names.pop(0) if above else None)

    def _bucket(self, x: Column, inner: Column, leftequal: bool) -> Column:
        """From 1: number of thresholds at or below x (below x), and one."""
        return F.size(F.filter(inner, (lambda t: t <= x) if leftequal else (lambda t: t < x))) + 1

    def _by_quantiles(self, v: Val, x: Column, inner: list[float], names: list[str], leftequal: bool, env: Env, plain: bool) -> Column:
        parts = env.parts if v.flag is None else (*env.parts, v.flag)
        over = self.over(replace(env, final=False, parts=parts), plain and v.flag is None, self.reading_stable and v.flag is None)
        y = x.cast("double")
        if not parts:
            y = self.stage(y)
        thresholds = self.quantiles_of(over, y, inner)
        return F.when(x.isNotNull(), F.element_at(F.array(*map(F.lit, names)), self._bucket(y, thresholds, leftequal)))

    def _by_moving(self, x: Column, items, env: Env, boundedness: str, bucketstrs, look: dict[str, Any]) -> Column:
        """Breaks that are computed: labels are put together row by row, as ``interval_labels`` names intervals of real numbers."""
        style, leftequal, label = look["style"], look["leftequal"], look["label"]
        if style.mixedfraction or style.conversion:
            raise SpecError("discretize: mixedfraction and conversion need literal breaks", "invalid_spec", "discretize")
        breaks = F.array_sort(F.array(*(self.value(i, replace(env, final=False)).col.cast("double") for i in items)))
        below, above = boundedness in ("unbounded", "boundedabove"), boundedness in ("unbounded", "boundedbelow")
        compact = label == "" if look["compact"] is None else look["compact"]
        n, k = len(items), self._bucket(x, breaks, leftequal) - 1  # breaks passed
        count = n - 1 + below + above
        at = lambda i: F.element_at(breaks, i)
        if not above:
            k = F.when(x == at(F.lit(n)), n - 1).otherwise(k)
        if not below:
            k = F.when(x == at(F.lit(1)), 1).otherwise(k)
        inside = x.isNotNull() & (F.lit(True) if below else k > 0) & (F.lit(True) if above else k < n)
        if bucketstrs:
            if len(bucketstrs) != count:
                raise SpecError(f"discretize: {count} labels are needed, got {len(bucketstrs)}", "invalid_spec")
            return F.when(inside, F.element_at(F.array(*map(F.lit, bucketstrs)), k + int(below)))
        with_hi = (F.lit(False) if above else k == n - 1) | F.lit(not leftequal)
        with_lo = (F.lit(False) if below else k == 1) | F.lit(leftequal)
        first, last = style.column(at(F.lit(1))), style.column(at(F.lit(n)))
        lo, hi = style.column(at(F.greatest(k, F.lit(1)))), style.column(at(F.least(k + 1, F.lit(n))))
        less, more = "<" if leftequal else "≤", "≥" if leftequal else ">"
        if compact:
            under, over, middle = F.concat(F.lit(less), first), F.concat(F.lit(more), last), F.concat(F.when(with_lo, "[").otherwise("("), lo, F.lit(","), hi, F.when(with_hi, "]").otherwise(")"))
        else:
            name = f"|{label}|" if look["absolute"] else label
            under, over = F.concat(F.lit(f"{name} {less} "), first), F.concat(last, F.lit(f" {'≤' if leftequal else '<'} {name}"))
            middle = F.concat(lo, F.when(with_lo, " ≤ ").otherwise(" < "), F.lit(name), F.when(with_hi, " ≤ ").otherwise(" < "), hi)
        out = F.when(k == 0, under).when(k == n, over).otherwise(middle)
        if look["rank"]:
            place = F.lit(count) - (k + int(below)) + 1 if look["reverse"] else k + int(below)
            out = F.concat(F.lpad(place.cast("string"), len(str(count)), " "), F.lit(look["ranksep"]), out)
        return F.when(inside, out)

    def quantiles(self, v: Val, qs: Node | None, env: Env, ngroups=None, leftequal=True, prefix="", suffix="") -> Column:
        if qs is not None and ngroups is not None:
            raise SpecError("quantiles: boundaries and ngroups are mutually exclusive", "invalid_spec")
        if qs is None:
            n = 4 if ngroups is None else ngroups
            if n < 2:
                raise SpecError("quantiles: ngroups must be at least 2", "invalid_spec")
            inner = [i / n for i in range(1, n)]
        else:
            got = self.constant(qs)
            inner = [float(q) for q in (got if isinstance(got, list) else [got])]
        try:
            names = quantile_labels(inner, leftequal, prefix, suffix)
        except ValueError as e:
            raise SpecError(str(e), "invalid_spec") from None
        return self._by_quantiles(v, self.number(v.col)[0], inner, names, leftequal, env, self.reading_plain)

    def topnames(self, node: Call, env: Env, absolute=False, ranksep=". ", dense=True, tol=0, others="Others", parens=False) -> Val:
        n = self.constant(node.args[2])
        name = self.value(node.args[0], env).col.cast("string")
        measure = self.value(node.args[1], env)
        m = self.stage(self.number(measure.col)[0], "m")
        name = self.stage(name, "n")
        place = F.dense_rank() if dense else F.rank()
        ok = name.isNotNull() & m.isNotNull()
        if absolute:
            ok = self.stage(ok & (F.abs(m) >= tol), "f")
            first = place.over(Window.partitionBy(*env.parts, ok).orderBy(F.abs(m).desc(), m.desc()))
            ok = self.stage(ok & (first <= n), "f")
        rank = place.over(Window.partitionBy(*env.parts, ok).orderBy(m.desc()))
        shown = F.when(m < 0, F.concat(F.lit("("), name, F.lit(")"))).otherwise(name) if absolute and parens else name
        label = F.concat(F.lpad(rank.cast("string"), len(str(n)), " "), F.lit(ranksep), shown)
        return Val(F.when(ok & (rank <= n), label).otherwise(others), window=True)

    # -- elementwise

    def constant(self, node: Node) -> Any:
        """A literal, a symbol or a list of them, as Python has it."""
        match node:
            case Lit(v):
                return v
            case Sym(name):
                return name
            case Arr(items):
                return [self.constant(i) for i in items]
            case Call("-", (x,)):
                return -self.constant(x)
            case Call("/", (a, b)):
                return self.constant(a) / self.constant(b)
            case Col(name) if name in ("missing", "nothing"):
                return None
        raise SpecError(f"'{text(node)}' must be a literal here", "invalid_spec", text(node), None, node.span)

    def elementwise(self, node: Call, env: Env) -> Val:
        name = node.name.removeprefix(".") if node.name.startswith(".") else node.name
        name = {"≠": "!=", "≤": "<=", "≥": ">=", "∈": "in"}.get(name, name)
        if name in ("in", "∉"):
            return self.member(node, env, name == "∉")
        if name == "where":
            cond = self.value(node.args[0], env)
            labels = {k: self.value(v, env) for k, v in node.kwargs}
            self._condition(cond.col, "where")
            yes = labels["true_label"].col
            no = labels["false_label"].col if "false_label" in labels else F.concat(F.lit("Not "), yes)
            return self.joined([cond], F.when(cond.col, yes).when(~cond.col, no))
        vals = [self.value(a, env) for a in node.args]
        cols = [v.col for v in vals]
        kw = {k: self.constant(v) for k, v in node.kwargs}
        if name == "onlyif":
            self._condition(cols[0], "onlyif")
            return self.joined(vals, F.when(cols[0], cols[1]))
        return self.joined(vals, self.scalar(name, cols, kw, node))

    def _condition(self, col: Column, who: str) -> None:
        if not isinstance(self.dtype(col), (T.BooleanType, T.NullType)):
            raise SpecError(f"{who}: the condition isn't true or false", "invalid_spec", who)

    def member(self, node: Call, env: Env, negate: bool) -> Val:
        item, coll = node.args
        v = self.value(item, env)
        if isinstance(coll, Arr) and all(isinstance(i, (Lit, Sym)) for i in coll.items):
            found = v.col.isin([self.constant(i) for i in coll.items]) if coll.items else F.when(v.col.isNotNull(), False)
        elif isinstance(coll, Arr):
            found = F.array_contains(F.array(*(self.value(i, env).col for i in coll.items)), v.col)
        else:
            inner = replace(env, final=False)
            y = self.settled(self.value(coll, inner), env)
            plain = self.reads_plain(env, coll)
            over = self.over(env, plain)
            if env.final:
                hit = F.array_contains(over(F.collect_set(y.masked)), v.col)
            else:
                v = self.settled(v, env)
                hit = self.held(v.col, y, env, plain)
            gap = F.lit(False) if y.skip else over(self.rows(y)) > over(F.count(y.masked))
            found = F.when(hit, True).when(v.col.isNotNull() & ~gap, False)
            v = replace(v, window=True)
        return replace(v, col=~found if negate else found)

    def held(self, x: Column, y: Val, env: Env, plain: bool) -> Column:
        """Whether y's values in the row's partition hold x: a join with the distinct ones, which are never gathered in a task."""
        self.flush()
        parts, value, mark = [temp("j") for _ in env.parts], temp("j"), temp("f")
        known = (self.plain.df if plain else self.df).select(*(p.alias(n) for p, n in zip(env.parts, parts, strict=True)), y.masked.alias(value)).where(c(value).isNotNull()).distinct()
        self.attach(env.parts, parts, known.withColumn(mark, F.lit(True)), x == c(value))
        self.df = self.df.drop(value)
        return F.coalesce(c(mark), F.lit(False))

    def scalar(self, name: str, x: list[Column], kw: dict[str, Any], node: Call) -> Column:
        a, b = x[0], x[1] if len(x) > 1 else None
        if name in ("==", "!=", "<", "<=", ">", ">="):
            return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[name]
        if name == "!":
            return ~a
        if name in ("+", "-", "*"):
            x = [self.number(v)[0] for v in x]
            if len(x) == 1:
                return -x[0] if name == "-" else x[0]
            out = x[0]
            for v in x[1:]:
                out = out + v if name == "+" else out - v if name == "-" else out * v
            return out
        if name == "/":
            a, b = (self.number(v)[0].cast("double") for v in x)
            return F.when(b == 0, a * F.lit(INF)).otherwise(a / b)
        if name == "^":
            (a, ka), (b, kb) = map(self.number, x)
            if not (isinstance(ka, INTEGRAL) and isinstance(kb, INTEGRAL)):
                return F.pow(a, b)
            n = node.args[1].value if isinstance(node.args[1], Lit) else None
            return self.exact(F.pow(a, b), "^", F.lit(False)) if n is None or not 0 < n < 64 else self.multiplied(a.cast("long"), n)
        if name in ("log", "log2", "log10"):
            base, v = (None, a) if b is None else (a, b)
            v = self.number(v)[0].cast("double")
            own = {"log": F.log, "log2": F.log2, "log10": F.log10}[name](v)
            return F.when(v == 0, F.lit(-INF)).otherwise(own if base is None else own / F.log(base.cast("double")))
        if name in ("exp", "sqrt"):
            return getattr(F, name)(self.number(a)[0].cast("double"))
        if name == "abs":
            return F.abs(self.number(a)[0])
        if name in ("round", "floor", "ceil"):
            a, kind = self.number(a)
            digits, base, f = kw.get("digits", 0), kw.get("base", 10), {"round": F.rint, "floor": F.floor, "ceil": F.ceil}[name]
            if (ties := kw.get("ties", "even")) not in ("even", "away"):
                raise SpecError(f"{name}: ties is :even or :away", "invalid_spec", name)
            if ties == "away":
                f = F.round
            if "sigdigits" in kw:
                if "digits" in kw:
                    raise SpecError(f"{name}: digits and sigdigits are mutually exclusive", "invalid_spec", name)
                a = a.cast("double")
                size = F.floor(F.log10(F.abs(a)) if base == 10 else F.log(F.abs(a)) / F.log(F.lit(float(base))))
                return F.when((a == 0) | F.isnan(a) | (F.abs(a) == INF), a).otherwise(self.rounded(f, a, F.lit(kw["sigdigits"] - 1) - size, base))
            if isinstance(kind, INTEGRAL) and digits >= 0:
                return a
            a = a.cast("double")
            if base != 10:
                return self.rounded(f, a, F.lit(digits), base).cast("double")
            if name == "round":
                return f(a) if digits == 0 else (F.round if ties == "away" else F.bround)(a, digits)
            f = F.floor if name == "floor" else F.ceil
            return f(a).cast("double") if digits == 0 else f(a * 10.0**digits).cast("double") / 10.0**digits
        if name in ("min", "max"):
            if len(x) == 1:
                return a
            gap = x[0].isNull()
            for v in x[1:]:
                gap = gap | v.isNull()
            return F.when(~gap, (F.least if name == "min" else F.greatest)(*x))
        if name == "ismissing":
            return a.isNull()
        if name == "coalesce":
            return F.coalesce(*x)
        if name in ("yyyy", "yyyyq", "yyq", "yyyymm", "yymm"):
            delim = self.constant(node.args[1]) if len(node.args) > 1 else ""
            year = F.date_format(a, "yyyy" if name.startswith("yyyy") else "yy")
            if name == "yyyy":
                return year
            if name.endswith("q"):
                return F.concat(year, F.lit("Q"), F.quarter(a).cast("string"))
            return F.concat(year, F.lit(delim), F.date_format(a, "MM"))
        raise SpecError(f"no lowering of '{name}'", "unknown_op", name)

    @staticmethod
    def multiplied(a: Column, n: int) -> Column:
        """a to the power of n >= 1 in whole numbers, by squaring."""
        out = None
        while n:
            if n & 1:
                out = a if out is None else out * a
            n >>= 1
            a = a * a if n else a
        return out

    @staticmethod
    def rounded(f: Callable[[Column], Column], x: Column, digits: Column, base: int) -> Column:
        """x brought to a multiple of base to the power of -digits by ``f``."""
        up, down = F.pow(F.lit(float(base)), digits), F.pow(F.lit(float(base)), -digits)
        return F.when(digits >= 0, f(x * up) / up).otherwise(f(x / down) * down)

    def hosted(self, op: registry.OpDef, node: Call, env: Env) -> Val:
        kw = {k: self.constant(v) for k, v in node.kwargs}
        if op.shape == "reduce":
            vals = [self.settled(self.value(a, replace(env, final=False)), env) for a in node.args]
            own = op.host(*(v.masked for v in vals), **kw)
            if env.final or not env.parts:
                return Val(self.over(env)(own), window=not env.final)
            return Val(own.over(Window.partitionBy(*env.parts)), window=True)  # a pandas UDF can't be aggregated along with others
        vals = [self.value(a, env) for a in node.args]
        if op.shape == "elementwise":
            return self.joined(vals, op.host(*(v.col for v in vals), **kw))
        lead = next((v for v in vals if v.flag is not None), None)
        return replace(self.joined(vals, op.host(*(v.col for v in vals), window=self.window(env, lead), **kw)), window=True)

    # -- entries

    def dimension(self, body: Node) -> Column:
        """The spec's value for each row; afterwards ``df`` bears what it needs."""
        col = self.value(body).col
        self.flush()
        return col

    def aggregate(self, body: Node) -> Column:
        """An aggregate Column for ``df.groupBy(keys)``."""
        env = replace(self.env, final=True)
        return self.value(body, env).col
