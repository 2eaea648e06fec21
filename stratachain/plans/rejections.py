"""What to type instead: repairs of near misses and of other languages' spellings."""

from __future__ import annotations

from ..errors import SpecError
from ..functions import registry

#: Spellings of other tools (lower case, without underscores) and the spelling here.
_FOREIGN_TEXT = """
avg average: mean(x)
stddev stdev sd: std(x)
variance: var(x)
n rowcount size len: nrow or length(x)
nunique ndistinct countdistinct: countuniq(x)
distinct unique: countuniq(x), uniqvalue(x) or strjoinuniq(x)
groupconcat stringagg listagg concat strjoin: strjoinuniq(x)
ifelse if: where(cond), onlyif(cond, x) or arithmetic on a condition
nullif: onlyif(a != b, a)
stopifnull: onlyif(cond, x)
allequal: isuniform(x) or countuniq(x, skipna = false) == 1
ifthen iif casewhen switch: where(cond) or discretize(x, breaks)
filter subset: where(cond) as a chain key
rownumber rowid: ordinalrank(x)
ntile: quantiles(x, ngroups = 4)
herfindahl herfindahlhirschman hhiindex concentration: hhi(x)
percentile percentilecont: quantile(x, 0.9)
top topn: topnames(labels, values, n)
cut bin: discretize(x, breaks)
ifnull nvl fillna fillmissing: coalesce(x, 0)
isnull isna: ismissing(x)
dropna dropmissing naomit: skipmissing(x)
argmax maxby: last(_) |> orderby(col)
argmin minby: first(_) |> orderby(col)
shift: lag(x) or lead(x)
runningtotal: cumsum(x)
sumif: sum(x * (cond))
countif: count(cond)
"""
FOREIGN = {name: use.strip() for line in _FOREIGN_TEXT.strip().splitlines() for names, _, use in [line.partition(":")] for name in names.split()}


def distance(a: str, b: str) -> int:
    """Edits between two words; a swap of neighbours is one."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return one[-1]


def nearest(word: str, among) -> str | None:
    """The one candidate within the budget (0, 1 or 2 edits by length); of equally near ones the one that shares most of its start."""
    budget = 0 if len(word) < 2 else 1 if len(word) < 4 else 2
    found = []
    for c in among:
        if (c[:1].isalpha() or c[:1] == "_") != (word[:1].isalpha() or word[:1] == "_"):
            continue
        d = 0 if c.lower() == word.lower() else distance(word.lower(), c.lower())
        if d <= budget:
            start = next((k for k, (x, y) in enumerate(zip(word, c, strict=False)) if x != y), min(len(word), len(c)))
            found.append((d, -start, c))
    found.sort()
    if len(found) > 1 and found[0][:2] == found[1][:2]:
        return None
    return found[0][2] if found else None


def repair(word: str, among) -> tuple[str, str | None]:
    """(" -- did you mean 'X'?" or the list of what there is, the drop-in or None)."""
    among = list(among)
    if (best := nearest(word, among)) is not None:
        return f" -- did you mean '{best}'?", best
    return (f". Accepted: {', '.join(sorted(among))}" if among else ""), None


def unknown_op(name: str, span: tuple[int, int], nested: bool = True) -> SpecError:
    from .parser import PARTITION_WORDS

    if name in registry.RESERVED:
        return SpecError(f"'{name}' is a postfix modifier: it must follow the spec, as in f(x) |> {name}(column)", "modifier_misuse", name, None, span)
    if name in PARTITION_WORDS:
        return SpecError(f"'{name}' isn't an operator: a dimension is partitioned by everything to its left in the chain, so put the column there as a chain KEY; for one value a group, NEST it in a reduction with |> groupby(key)", "modifier_misuse", name, None, span)
    plain = name.replace("_", "").lower()
    if plain != name and (plain in registry.list_ops()):
        return SpecError(f"'{name}': operators are spelt in lower case without '_' -- did you mean '{plain}'?", "spelling_convention", name, plain, span)
    if plain in FOREIGN:
        return SpecError(f"'{name}' is spelt {FOREIGN[plain]} here", "foreign_spelling", name, None, span)
    if (best := nearest(name, [o for o in registry.list_ops() if o[0].isalpha()])) is not None:
        return SpecError(f"unknown operator '{name}' -- did you mean '{best}'?", "unknown_op", name, best, span)
    words = [o for o in registry.list_ops() if o[0].isalpha()]
    return SpecError(f"unknown operator '{name}'. Operators: {', '.join(words)}", "unknown_op", name, None, span)
