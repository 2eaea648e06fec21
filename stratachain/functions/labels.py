"""Labels of intervals and quantile groups, and number formatting. Labels are made when a plan is made, but for breaks that are computed."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDEDNESS = ("unbounded", "bounded", "boundedbelow", "boundedabove")
_SCALES = {"metric": [(1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K")], "finance": [(1e12, "t"), (1e9, "b"), (1e6, "m"), (1e3, "k")]}


@dataclass(frozen=True)
class Style:
    """How boundary numbers are written."""

    prefix: str = ""
    suffix: str = ""
    scale: float = 1
    precision: int = -1
    commas: bool = False
    stripzeros: bool | None = None
    parens: bool = False
    mixedfraction: bool = False
    autoscale: str = "none"
    conversion: str = ""

    def number(self, x) -> str:
        v = x * self.scale
        strip = self.precision == -1 if self.stripzeros is None else self.stripzeros
        unit = ""
        if self.autoscale in _SCALES:
            for size, name in _SCALES[self.autoscale]:
                if abs(v) >= size:
                    v, unit = v / size, name
                    break
        if self.mixedfraction and v != int(v):
            f = Fraction(abs(v)).limit_denominator(64)
            whole, part = divmod(f, 1)
            s = (f"{int(whole)}_" if whole else "") + f"{part.numerator}/{part.denominator}"
        elif self.conversion in ("e", "E", "g", "G", "x", "X", "o", "b"):
            digits = "" if self.precision < 0 else f".{self.precision}"
            s = format(abs(v) if self.conversion in "eEgG" else abs(int(v)), digits + self.conversion if self.conversion in "eEgG" else self.conversion)
        else:
            d = abs(Decimal(repr(v)) if isinstance(v, float) else Decimal(v))
            d = d.quantize(Decimal(1).scaleb(-(6 if self.precision < 0 else self.precision)), ROUND_HALF_EVEN) if isinstance(v, float) or self.precision >= 0 else d
            s = format(d, ",f" if self.commas else "f")
            if strip and "." in s:
                s = s.rstrip("0").rstrip(".")
        s += unit
        if v < 0 and s.strip("0.,") != "":
            s = f"({s})" if self.parens else f"-{s}"
        return self.prefix + s + self.suffix

    def column(self, x: Column) -> Column:
        """``number`` of a real-valued Column; without mixed fractions and conversions."""
        v, unit = x * float(self.scale), F.lit("")
        for size, name in reversed(_SCALES.get(self.autoscale, [])):
            unit = F.when(F.abs(x * float(self.scale)) >= size, F.lit(name)).otherwise(unit)
            v = F.when(F.abs(x * float(self.scale)) >= size, x * float(self.scale) / size).otherwise(v)
        s = F.format_number(F.abs(v), 6 if self.precision < 0 else self.precision)
        s = s if self.commas else F.replace(s, F.lit(","), F.lit(""))
        if self.precision == -1 if self.stripzeros is None else self.stripzeros:
            s = F.regexp_replace(s, r"\.?0*$", "") if self.precision else s
        sign = (v < 0) & s.rlike("[1-9]")
        s = F.concat(s, unit)
        s = F.when(sign, F.concat(F.lit("("), s, F.lit(")")) if self.parens else F.concat(F.lit("-"), s)).otherwise(s)
        return F.concat(F.lit(self.prefix), s, F.lit(self.suffix))


def interval_labels(breaks: list, integral: bool, boundedness: str = "unbounded", leftequal: bool = True, absolute: bool = False, rank: bool = True, ranksep: str = ". ", label: str = "", compact: bool | None = None, reverse: bool = False, style: Style | None = None) -> list[str]:
    """One label for each interval between sorted breaks, the outer ones as ``boundedness`` has them.

    ``integral``: values and breaks are whole numbers, so that an interval is named by the numbers in it.
    """
    if boundedness not in BOUNDEDNESS:
        raise ValueError(f"boundedness is one of {', '.join(BOUNDEDNESS)}")
    style = style or Style()
    compact = label == "" if compact is None else compact
    below, above = boundedness in ("unbounded", "boundedabove"), boundedness in ("unbounded", "boundedbelow")
    num = style.number
    n = len(breaks)
    closed_top, closed_bottom = not above and leftequal, not below and not leftequal
    names: list[str] = []
    x = f"|{label}|" if absolute else label
    whole = compact and integral and style.scale == 1
    if below:
        b = breaks[0]
        if whole:
            names.append("≤" + num(b - 1 if leftequal else b))
        elif compact:
            names.append(("<" if leftequal else "≤") + num(b))
        else:
            names.append(f"{x} {'<' if leftequal else '≤'} {num(b)}")
    for i in range(n - 1):
        lo, hi = breaks[i], breaks[i + 1]
        with_lo = leftequal or (i == 0 and closed_bottom)
        with_hi = not leftequal or (i == n - 2 and closed_top)
        if whole:
            a, z = lo + (not with_lo), hi - (not with_hi)
            names.append(num(a) if a == z else f"{num(a)}…{num(z)}")
        elif compact:
            names.append(f"{'[' if with_lo else '('}{num(lo)},{num(hi)}{']' if with_hi else ')'}")
        else:
            names.append(f"{num(lo)} {'≤' if with_lo else '<'} {x} {'≤' if with_hi else '<'} {num(hi)}")
    if above:
        b = breaks[-1]
        if whole:
            names.append(num(b if leftequal else b + 1) + "+")
        elif compact:
            names.append(("≥" if leftequal else ">") + num(b))
        else:
            names.append(f"{num(b)} {'≤' if leftequal else '<'} {x}")
    if not rank:
        return names
    count = len(names)
    width = len(str(count))
    return [f"{(count - i if reverse else i + 1):>{width}}{ranksep}{s}" for i, s in enumerate(names)]


def percent(p: float) -> str:
    """25%, 12.5%, 33.33%: at most two decimals."""
    s = f"{p * 100:.2f}".rstrip("0").rstrip(".")
    return s + "%"


def quantile_labels(inner: list[float], leftequal: bool = True, prefix: str = "", suffix: str = "") -> list[str]:
    """Labels of the groups between quantiles 0, ``inner`` and 1."""
    if not inner:
        raise ValueError("quantiles: need at least one boundary")
    if any(a >= b for a, b in zip(inner, inner[1:], strict=False)):
        raise ValueError("quantiles: boundaries must be strictly increasing")
    if inner[0] <= 0 or inner[-1] >= 1:
        raise ValueError("quantiles: boundaries must be strictly inside (0, 1); 0 and 1 are implied")
    bounds = [0.0, *inner, 1.0]
    n = len(bounds) - 1
    width = len(str(n))
    out = []
    for i in range(n):
        first, last = i == 0, i == n - 1
        left, right = ("[", "]" if last else ")") if leftequal else ("[" if first else "(", "]")
        core = f"{left}{percent(bounds[i])}, {percent(bounds[i + 1])}{right}"
        out.append(f"{i + 1:>{width}}. " + " ".join(x for x in (prefix, core, suffix) if x))
    return out
