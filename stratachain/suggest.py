"""Starter specs, vocabulary and column helpers for an editor of specs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SpecError
from .functions import registry
from .plans.parser import MODIFIERS
from .plans.rejections import nearest
from .plans.specs import parse_aggr, parse_dim

#: Rows looked at for facts about a column, and distinct values up to which it counts as categorical.
SCAN, FEW = 20_000, 64
#: Rows that templates are tried on.
TRIED = 50


@dataclass(frozen=True)
class Template:
    """A spec that parses and, if it was offered for a frame and not for types only, runs on rows of it."""

    spec: str
    label: str


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "array" if isinstance(kind, T.ArrayType) else "text" if isinstance(kind, T.StringType) else "other"


def spec_columns(source: DataFrame | Mapping[str, T.DataType]) -> list[str]:
    return list(source.columns) if isinstance(source, DataFrame) else list(source)


def spec_coltype(source: DataFrame | Mapping[str, T.DataType], name: str) -> T.DataType | None:
    kinds = {f.name: f.dataType for f in source.schema} if isinstance(source, DataFrame) else source
    return kinds.get(name)


def _facts(df: DataFrame, name: str) -> tuple[bool, bool]:
    """(has missing values, few distinct ones), from a bounded look."""
    x = df.select(F.col(f"`{name}`").alias("x")).limit(SCAN)
    missing, distinct = x.agg(F.count_if(F.col("x").isNull()), F.approx_count_distinct("x")).first()
    return missing > 0, distinct <= FEW


def _plain(names: Iterable[str]) -> list[str]:
    return [n for n in names if n.isidentifier() and n not in registry.RESERVED and n not in ("true", "false", "_")]


def spec_templates(kind: str, source: DataFrame | Mapping[str, T.DataType], target: str | None = None, facts: bool = True) -> list[Template]:
    """Ranked specs for an aggregation of ``target`` (kind "aggr"), or dimensions (kind "dim") about ``target``."""
    if kind not in ("aggr", "dim"):
        raise ValueError("kind is aggr or dim")
    kinds = {f.name: f.dataType for f in source.schema} if isinstance(source, DataFrame) else dict(source)
    names = _plain(kinds)
    of = {n: family(kinds[n]) for n in names}
    numbers = [n for n in names if of[n] == "number" and n != target]
    dates = [n for n in names if of[n] == "date" and n != target]
    texts = [n for n in names if of[n] == "text" and n != target]
    missing, _ = _facts(source, target) if facts and isinstance(source, DataFrame) and target in kinds else (False, True)
    fam = family(kinds[target]) if target in kinds else None
    out: list[tuple[str, str]] = []
    add = lambda spec, label: out.append((spec, label))
    if kind == "aggr":
        x = "skipmissing(_)" if missing else "_"
        if fam == "number":
            for op, label in (("sum", "total"), ("mean", "average"), ("median", "median"), ("minimum", "least"), ("maximum", "greatest"), ("std", "spread")):
                add(f"{op}({x})", label)
            add(f"quantile({x}, 0.9)" if not missing else "median(skipmissing(_))", "upper tail")
            add("hhi(_)", "concentration")
            for w in numbers[:2]:
                add(f"wmeanfallback(_, [{w}, 1])", f"average weighted by {w}")
        elif fam == "bool":
            add(f"count({x})", "how many are true")
            add(f"mean({x})", "share that is true")
            add(f"any({x})", "any")
            add(f"all({x})", "all")
        elif fam == "array":
            add("unionall(_)", "distinct elements")
        elif fam == "date":
            add(f"minimum({x})", "earliest")
            add(f"maximum({x})", "latest")
        if fam != "array":
            add("uniqvalue(_)", "the one value")
            add("countuniq(_)", "distinct values")
        if fam == "text":
            add("strjoinuniq(_)", "all values as one text")
        for d in dates[:1]:
            add(f"last(_) |> orderby({d})", f"latest by {d}")
            add(f"first(_) |> orderby({d})", f"earliest by {d}")
        if fam == "number":
            for k in texts[:2]:
                add(f"mean(sum({x}) |> groupby({k}))", f"average total by {k}")
            if texts:
                add(f"onlyif(isuniform({texts[0]}), sum({x}))", f"total where {texts[0]} is one")
        add("length(_)", "rows")
    else:
        if fam == "number":
            add(f"quantiles({target}, ngroups = 4)", "quarters")
            add(f"rank({target}, rev = true)", "rank, greatest first")
            add(f"{target} / sum({target})", "share")
            add(f"({target} - mean({target})) / std({target})", "z-score")
            for d in dates[:1]:
                add(f"cumsum({target}) |> orderby({d})", f"running total by {d}")
                add(f"lag({target}) |> orderby({d})", f"the one before by {d}")
            for k in texts[:2]:
                add(f"topnames({k}, {target}, 5)", f"top {k}")
                add(f"cumsum({target}) |> groupby({k}) |> orderby({target} => :desc)", f"Pareto of {k}")
            add(f"where({target} > 0)", "positive or not")
        elif fam == "date":
            for f, label in (("yyyy", "year"), ("yyyyq", "quarter"), ("yyyymm", "month")):
                add(f"{f}({target})", label)
        elif fam == "bool":
            add(f"where({target})", "by condition")
        elif fam == "text":
            for m in numbers[:2]:
                add(f"topnames({target}, {m}, 5)", f"top by {m}")
            add(f"countuniq({target})", "distinct values")
        elif target is None:
            for m in numbers[:3]:
                add(f"quantiles({m}, ngroups = 4)", f"quarters of {m}")
            for d in dates[:2]:
                add(f"yyyymm({d})", f"month of {d}")
            for k in texts[:1]:
                for m in numbers[:1]:
                    add(f"topnames({k}, {m}, 5)", f"top {k} by {m}")
    made = {}
    for spec, label in out:
        try:
            (parse_aggr if kind == "aggr" else parse_dim)(spec, names)
        except SpecError:
            continue
        made.setdefault(spec, Template(spec, label))
    if isinstance(source, DataFrame):
        few = source.sparkSession.createDataFrame(source.limit(TRIED).collect(), source.schema)
        made = {t.spec: t for t in _running(kind, few, target if target in kinds else names[0] if names else None, list(made.values()))}
    return list(made.values())


def _running(kind: str, few: DataFrame, target: str | None, tried: list[Template]) -> list[Template]:
    """Those of the specs that run on the rows given: all at once, and where that fails each half by itself."""
    from .operators.chain import agg, dim

    if not tried or kind == "aggr" and target is None:
        return []
    try:
        if kind == "aggr":
            made = agg(few, [], cols=[(target, t.spec, f"__tried_{i}") for i, t in enumerate(tried)])
        else:
            made = dim(few, *((f"__tried_{i}", t.spec) for i, t in enumerate(tried)))
        made.collect()
        return tried
    except Exception:  # whatever Spark objects to, the spec isn't offered
        half = len(tried) // 2
        return _running(kind, few, target, tried[:half]) + _running(kind, few, target, tried[half:]) if half else []


def spec_vocabulary(kind: str, columns: Iterable[str] = ()) -> list[str]:
    """All words that may stand in a spec: operators, columns, modifiers; '_' in aggregations."""
    words = {o for o in registry.list_ops() if o[0].isalpha()} | set(_plain(columns)) | set(MODIFIERS)
    return sorted(words | ({"_"} if kind == "aggr" else set()))


def complete(kind: str, prefix: str, columns: Iterable[str] = ()) -> list[str]:
    """Words that begin with ``prefix``, else the one that is nearest."""
    words = spec_vocabulary(kind, columns)
    found = [w for w in words if w.startswith(prefix)]
    if found:
        return found
    best = nearest(prefix, words)
    return [best] if best else []
