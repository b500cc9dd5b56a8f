"""Regular bag expressions: whether counts of symbols can be told apart into the parts of an expression.

An expression is ("symbol", number, low, high), ("each", parts, low, high) or ("one", parts, low, high): as many of a symbol,
all parts in any order, or one of the parts, each low to high times. Every place of a symbol has a number of its own.

Where each thing is one symbol, counts decide by intervals (``interval``, columns): the numbers of repetitions of a part that its counts
allow are an interval, all parts of "each" share theirs, those of "one" add theirs up. Where a thing may be any of several symbols
(a class of them), ``fits`` decides for one combination of class counts whether some choice does: numbers of repetitions are unknowns, the choice is a
flow from classes to symbols, whose conditions by Hall and Hoffman are inequalities between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A bound from here on is none.
MANY = 1 << 30
NONE = 1 << 61

Row = tuple[dict[int, int], int]


def interval(e: tuple, count: Callable[[int], Column]) -> tuple[Column, Column]:
    """The least and greatest number of repetitions of e that the counts allow, NONE for no bound; none at all where the least is greater."""
    kind, parts, low, high = e
    if kind == "symbol":
        least = most = count(parts).cast("long")
    else:
        inner = [interval(x, count) for x in parts]
        if kind == "each":
            least, most = reduce(F.greatest, (a for a, _ in inner)), reduce(F.least, (b for _, b in inner))
        else:
            empty = reduce(lambda a, b: a | b, (a > b for a, b in inner))
            least = F.when(empty, NONE).otherwise(reduce(_plus, (a for a, _ in inner)))
            most = F.when(empty, 0).otherwise(reduce(_plus, (b for _, b in inner)))
        if (low, high) == (1, 1):
            return least, most
    # i repetitions of e mean low * i to high * i of what it holds.
    none = least > most
    if high == 0:
        none |= least > 0
    from_ = F.when(least > 0, 1).otherwise(0).cast("long") if high >= MANY or high == 0 else _divided(least + (high - 1), high)
    to = F.lit(NONE) if low == 0 else F.when(most >= NONE, NONE).otherwise(_divided(most, low))
    return F.when(none, NONE).otherwise(from_), F.when(none, 0).otherwise(to)


def _plus(a: Column, b: Column) -> Column:
    return F.when((a >= NONE) | (b >= NONE), NONE).otherwise(a + b)


def _divided(a: Column, n: int) -> Column:
    return a if n == 1 else F.call_function("div", a, F.lit(n).cast("long"))


def once(e: tuple, count: Callable[[int], Column]) -> Column:
    """Whether the counts are those of the expression, each thing being one symbol."""
    least, most = interval(e, count)
    return (least <= 1) & (most >= 1)


def fits(e: tuple, classes: dict[frozenset[int], int]) -> bool:
    """Whether things that may each be any symbol of their class can be taken as symbols so that the expression holds.

    classes: how many things there are of each class, a class being the symbols that fit.
    """
    classes = {c: n for c, n in classes.items() if n}
    total = sum(classes.values())
    rows: list[Row] = []
    bounds: dict[int, tuple[int, int, int]] = {}  # symbol -> unknown, low, high
    unknowns, largest = 1, 1

    def repeated(k: int, low: int, high: int) -> int:
        nonlocal unknowns, largest
        if (low, high) == (1, 1):
            return k
        j, unknowns, largest = unknowns, unknowns + 1, largest * max(1, low)
        rows.append(({j: 1, k: -low}, 0))
        rows.append(({j: -1, k: min(high, max(total, low))}, 0))
        return j

    def walk(e: tuple, k: int) -> None:
        nonlocal unknowns
        kind, parts, low, high = e
        if kind == "symbol":
            bounds[parts] = (k, low, min(high, total))
            return
        j = repeated(k, low, high)
        if kind == "each" or len(parts) == 1:
            for x in parts:
                walk(x, j)
            return
        own = list(range(unknowns, unknowns + len(parts)))
        unknowns += len(parts)
        rows.append(({j: -1} | dict.fromkeys(own, 1), 0))
        rows.append(({j: 1} | dict.fromkeys(own, -1), 0))
        for x, i in zip(parts, own, strict=True):
            walk(x, i)

    walk(e, 0)
    for symbols, own in _connected(bounds, classes):
        rows += _flow(symbols, own, bounds)
    most = (total + 1) * largest
    return _solvable(rows, [1] + [0] * (unknowns - 1), [1] + [most] * (unknowns - 1))


def _connected(symbols: Iterable[int], classes: dict[frozenset[int], int]) -> list[tuple[set[int], dict[frozenset[int], int]]]:
    """Symbols that classes connect, with these classes; what isn't connected decides alone."""
    groups: list[set[int]] = [{s} for s in symbols]
    for c in classes:
        touched = [g for g in groups if g & c]
        groups = [g for g in groups if not g & c] + [set().union(*touched)]
    return [(g, {c: n for c, n in classes.items() if c & g}) for g in groups]


def _sets(items: list) -> Iterable[tuple]:
    for n in range(len(items) + 1):
        yield from combinations(items, n)


def _flow(symbols: set[int], classes: dict[frozenset[int], int], bounds: dict[int, tuple[int, int, int]]) -> list[Row]:
    """The conditions for a flow: what fits only some symbols is at most what these take, what fits any of some at least what they need."""

    def summed(own: Iterable[int], side: int, sign: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for s in own:
            out[bounds[s][0]] = out.get(bounds[s][0], 0) + sign * bounds[s][side]
        return out

    rows: list[Row] = []
    if len(symbols) <= len(classes):
        for own in map(set, _sets(sorted(symbols))):
            rows.append((summed(own, 2, 1), sum(n for c, n in classes.items() if c <= own)))
            rows.append((summed(own, 1, -1), -sum(n for c, n in classes.items() if c & own)))
    else:
        for some in _sets(list(classes)):
            count = sum(classes[c] for c in some)
            rows.append((summed(set().union(*some), 2, 1), count))
            rows.append((summed([s for s in symbols if all(c in some for c in classes if s in c)], 1, -1), -count))
    return rows


def _solvable(rows: list[Row], low: list[int], high: list[int]) -> bool:
    """Whether whole numbers within the bounds meet all rows (sums of coefficients times unknowns, at least a number): narrowing, then halving."""
    low, high = low[:], high[:]
    for _ in range(30):
        changed = False
        for row, least in rows:
            room = sum(a * (high[i] if a > 0 else low[i]) for i, a in row.items()) - least
            if room < 0:
                return False
            for i, a in row.items():
                if a > 0 and (new := high[i] - room // a) > low[i]:
                    low[i], changed = new, True
                elif a < 0 and (new := low[i] + room // -a) < high[i]:
                    high[i], changed = new, True
                if low[i] > high[i]:
                    return False
        if not changed:
            break
    if all(sum(a * low[i] for i, a in row.items()) >= least for row, least in rows):
        return True
    wide = max(range(len(low)), key=lambda i: high[i] - low[i])
    if low[wide] == high[wide]:
        return False
    middle = (low[wide] + high[wide]) // 2
    return _solvable(rows, low, [*high[:wide], middle, *high[wide + 1 :]]) or _solvable(rows, [*low[:wide], middle + 1, *low[wide + 1 :]], high)
