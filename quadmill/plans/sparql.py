"""SPARQL queries as DataFrame plans.

A solution table has a column for each variable and knows which are certainly bound, so that joins stay
equi-joins wherever they can: where no shared variable is certainly bound, solutions with and without one are
joined apart; where another one is, the condition lets NULL match. Beside a term that a table's column was
made into goes the column itself, so filters, constants and joins on keys reach the scans as they are.
FILTERs of a group apply to the whole group, those of an OPTIONAL are its join condition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..session import written
from .closure import Closure
from .expressions import Compiler, Native, Number, Value, constant, equal, no_whole, order_key, text, whole
from .sparql_parser import Query, SparqlError, has_aggregate, parse_query, visible

#: Equal solutions that one task numbers.
ALIKE = 1 << 16
#: Hidden variables that tell solutions apart begin so.
ROW = ".row"
NUMBERS = count()


def column_name(var: str) -> str:
    """Spark doesn't tell letter case apart, SPARQL does."""
    return ("h_" if var.startswith(".") else "v_") + "".join("~" + c.lower() if c.isupper() else c for c in var.lstrip("."))


def col(var: str) -> Column:
    return F.col(f"`{column_name(var)}`")


def native_name(var: str) -> str:
    return "n_" + column_name(var)


def copy(var: str) -> str:
    return ".kept " + var


@dataclass
class Solutions:
    df: DataFrame
    bound: dict[str, bool]  # variable -> certainly bound
    natives: dict[str, Native] = field(default_factory=dict)  # variable -> what its column native_name holds

    def column(self, var: str) -> Value | Column | None:
        """What an expression takes for a variable."""
        if var in self.natives:
            return self.natives[var].value(col(var), F.col(f"`{native_name(var)}`"))
        return col(var) if var in self.bound else None

    def where(self, condition: Column, bound: str | None = None) -> Solutions:
        """Those that a condition holds for, by which a variable may be certainly bound."""
        return Solutions(self.df.where(condition), self.bound if bound is None else {**self.bound, bound: True}, self.natives)

    def copied(self, names: list[str]) -> Solutions:
        """With a copy of some variables, which joins leave as it is."""
        return Solutions(self.df.select("*", *(col(n).alias(column_name(copy(n))) for n in names)), self.bound | {copy(n): self.bound[n] for n in names}, self.natives)

    def without(self, var: str) -> Solutions:
        """The same without a variable."""
        return Solutions(self.df.drop(column_name(var), native_name(var)), {n: c for n, c in self.bound.items() if n != var}, {n: k for n, k in self.natives.items() if n != var})

    def halves(self, var: str) -> list[Solutions]:
        """Those with a variable and, without its column, those that lack it."""
        if self.bound[var]:
            return [self]
        return [self.where(col(var).isNotNull(), var), self.where(col(var).isNull()).without(var)]

    def keep(self, names: list[str]) -> Solutions:
        return Solutions(self.df.select(*(col(n) if n in self.bound else F.lit(None).cast("string").alias(column_name(n)) for n in names)), {n: self.bound.get(n, False) for n in names})


def row_of(a: Solutions) -> str | None:
    """The variable that tells the solutions apart, where there is one."""
    return next((n for n in a.bound if n.startswith(ROW) and a.bound[n]), None)


def numbered(a: Solutions) -> Solutions:
    """With a hidden variable that differs between any two solutions, and stays with one through joins and retried tasks.

    It is made of a solution's values and its rank among equal ones. Equal solutions are counted and dealt out again by their
    count, a block at a time, so a solution that most rows have is no single task's.
    """
    by = a.df.columns
    counts = (a.df.groupBy(*(F.col(f"`{c}`") for c in by)) if by else a.df.groupBy()).agg(F.count(F.lit(1)).alias("x_same")).where("x_same > 0")
    several = F.col("x_same") > ALIKE
    first = counts.where(~several).withColumn("x_from", F.lit(0).cast("long"))
    blocks = counts.where(several).withColumn("x_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_same") - 1, F.lit(ALIKE).cast("long"))))
    dealt = first.unionByName(blocks.repartition("x_from", *(F.col(f"`{c}`") for c in by)))
    ranks = F.explode(F.sequence(F.col("x_from"), F.least(F.col("x_same"), F.col("x_from") + ALIKE) - 1))
    told = [F.coalesce(F.concat(F.length(col(n)).cast("string"), F.lit(":"), col(n)), F.lit("-")) for n in a.bound]
    name = f"{ROW}{next(NUMBERS)}"
    rows = dealt.withColumn("x_rank", ranks).withColumn(column_name(name), F.md5(F.concat(F.col("x_rank").cast("string"), F.lit(";"), *told).cast("binary")))
    return Solutions(rows.drop("x_same", "x_from", "x_rank"), {**a.bound, name: True}, a.natives)


def unit(spark: SparkSession) -> Solutions:
    return Solutions(spark.range(1).select(), {})


def renamed(right: Solutions) -> DataFrame:
    return right.df.select(*(col(n).alias("r_" + column_name(n)) for n in right.bound), *(F.col(f"`{native_name(n)}`").alias("r_" + native_name(n)) for n in right.natives))


def rcol(var: str) -> Column:
    return F.col(f"`r_{column_name(var)}`")


def rvalue(b: Solutions, var: str) -> Value | Column:
    """What an expression takes for a variable of b, with b's columns renamed."""
    return b.natives[var].value(rcol(var), F.col(f"`r_{native_name(var)}`")) if var in b.natives else rcol(var)


def alike(a: Solutions, b: Solutions, var: str) -> bool:
    """That both have a variable as the same kind of column."""
    return var in a.natives and a.natives[var] == b.natives.get(var) and a.natives[var].kind != "double"


def agreement(a: Solutions, b: Solutions, shared: list[str]) -> Column:
    """That two solutions are compatible, with b's columns renamed."""
    made = F.lit(True)
    for n in shared:
        same = F.col(f"`{native_name(n)}`") == F.col(f"`r_{native_name(n)}`") if alike(a, b, n) else col(n) == rcol(n)
        made &= same if a.bound[n] and b.bound[n] else same | col(n).isNull() | rcol(n).isNull()
    return made


def join(a: Solutions, b: Solutions) -> Solutions:
    shared = [n for n in a.bound if n in b.bound]
    if all(a.bound[n] and b.bound[n] for n in shared):
        natives = b.natives | a.natives
        if not shared:
            return Solutions(a.df.crossJoin(b.df), {**a.bound, **b.bound}, natives)
        by = [native_name(n) if alike(a, b, n) else column_name(n) for n in shared]
        twice = [c for n in shared for c in ([column_name(n)] if alike(a, b, n) else [native_name(n)] if n in a.natives and n in b.natives else [])]
        return Solutions(a.df.join(b.df.drop(*twice), by), {**a.bound, **b.bound}, natives)
    if apart := loose(a, b, shared):
        names = list(dict.fromkeys([*a.bound, *b.bound]))
        return united([join(x, y) for x in a.halves(apart) for y in b.halves(apart)], names)
    df = a.df.join(renamed(b), agreement(a, b, shared))
    return merged(df, a, b, shared, inner=True)


def loose(a: Solutions, b: Solutions, shared: list[str]) -> str | None:
    """The shared variable to tell solutions apart by, where none is certainly bound on both sides."""
    return None if not shared or any(a.bound[n] and b.bound[n] for n in shared) else shared[0]


def united(parts: list[Solutions], names: list[str]) -> Solutions:
    return Solutions(reduce(DataFrame.union, [x.keep(names).df for x in parts]), {n: all(x.bound.get(n, False) for x in parts) for n in names})


def merged(df: DataFrame, a: Solutions, b: Solutions, shared: list[str], inner: bool) -> Solutions:
    columns = [F.coalesce(col(n), rcol(n)).alias(column_name(n)) if n in shared and not a.bound[n] else col(n) for n in a.bound]
    columns += [rcol(n).alias(column_name(n)) for n in b.bound if n not in a.bound]
    bound = {n: c or (inner and b.bound.get(n, False)) for n, c in a.bound.items()} | {n: c and inner for n, c in b.bound.items() if n not in a.bound}
    mine = {n: k for n, k in a.natives.items() if n not in shared or a.bound[n]}
    theirs = {n: k for n, k in b.natives.items() if n not in a.bound}
    own = [F.col(f"`{native_name(n)}`") for n in mine] + [F.col(f"`r_{native_name(n)}`").alias(native_name(n)) for n in theirs]
    return Solutions(df.select(*columns, *own), bound, mine | theirs)


class Engine:
    """Runs queries over a graph store; services: name -> store; functions: IRI -> function of values."""

    def __init__(self, spark: SparkSession, store, services: dict | None = None, functions: dict | None = None, base: str | None = None):
        self.spark, self.store, self.services, self.functions, self.base = spark, store, services or {}, functions, base
        self.graphs: list[str] = []
        self.named: list[str] = []

    # -- scans
    def active(self, graph, p: str | None = None) -> DataFrame:
        """The quads of the active graph: s, p, o and, inside GRAPH ?g, g."""
        quads = self.store.quads(p)
        dataset = bool(self.graphs or self.named)
        if graph is None:
            if dataset:
                return quads.where(F.col("g").isin(self.graphs)).select("s", "p", "o").distinct() if self.graphs else quads.where(F.lit(False)).select("s", "p", "o")
            return quads.where("g IS NULL").select("s", "p", "o")
        if graph[0] == "iri":
            if dataset and graph[1] not in self.named:
                return quads.where(F.lit(False)).select("s", "p", "o")
            return quads.where(F.col("g") == graph[1]).select("s", "p", "o")
        named = quads.where("g IS NOT NULL")
        return (named.where(F.col("g").isin(self.named)) if dataset else named).select("s", "p", "o", "g")

    def shaped(self, df: DataFrame, places: list[tuple[str, tuple]], graph, natives: dict[str, Native] | None = None) -> Solutions:
        """Columns of df that stand for terms: constants filter, repeated variables must agree."""
        if graph is not None and graph[0] == "var":
            places = [*places, ("g", graph)]
        natives = natives or {}
        seen: dict[str, str] = {}
        for name, term in places:
            if term[0] != "var":
                own = natives.get(name)
                if own and own.kind == "key":
                    df = df.where(equal(own.value(F.col(name), F.col(f"native_{name}")), constant(term[1])))
                elif own and own.kind == "string" and term[1].endswith('"'):
                    df = df.where(F.col(f"native_{name}") == constant(term[1]).lex)
                else:
                    df = df.where(F.col(name) == term[1])
            elif term[1] in seen:
                df = df.where(F.col(name) == F.col(seen[term[1]]))
            else:
                seen[term[1]] = name
        kept = {v: natives[c] for v, c in seen.items() if c in natives}
        return Solutions(df.select(*(F.col(c).alias(column_name(v)) for v, c in seen.items()), *(F.col(f"native_{seen[v]}").alias(native_name(v)) for v in kept)), dict.fromkeys(seen, True), kept)

    def triple(self, s, verb, o, graph) -> Solutions:
        if verb[0] == "var":
            return self.shaped(self.active(graph), [("s", s), ("p", verb), ("o", o)], graph)
        path = verb[1]
        if path[0] == "iri":
            if not (self.graphs or self.named) and (made := self.store.star([path[1]])):
                return self.shaped(self.within(made[0], graph), [("s", s), ("o0", o)], graph, made[1])
            return self.shaped(self.active(graph, path[1]), [("s", s), ("o", o)], graph)
        return self.shaped(self.path(path, graph, s, o), [("s", s), ("o", o)], graph)

    def within(self, df: DataFrame, graph) -> DataFrame:
        """The rows of a scan (of a dataset without FROM) that are in the active graph."""
        return df.where("g IS NULL") if graph is None else df.where(F.col("g") == graph[1]) if graph[0] == "iri" else df.where("g IS NOT NULL")

    def bgp(self, triples: list, graph) -> Solutions:
        """Connected patterns first, those with constants before others; patterns of one subject are one scan where the store can."""
        if not triples:
            return unit(self.spark)
        left, units = list(triples), []
        by_subject: dict[tuple, list] = {}
        for t in left:
            if t[1][0] == "path" and t[1][1][0] == "iri" and t[0][0] == "var" and not (self.graphs or self.named):
                by_subject.setdefault(t[0], []).append(t)
        for subject, own in by_subject.items():
            if len({t[1][1][1] for t in own}) == len(own) > 1 and (made := self.store.star([t[1][1][1] for t in own])):
                units.append(self.shaped(self.within(made[0], graph), [("s", subject), *((f"o{i}", t[2]) for i, t in enumerate(own))], graph, made[1]))
                left = [t for t in left if t not in own]
        weight = lambda t: (sum(x[0] == "var" for x in (t[0], t[2])), t[1][0] == "var" or t[1][1][0] != "iri")
        units += [self.triple(*t, graph) for t in sorted(left, key=weight)]
        done = units.pop(0)
        while units:
            i = next((i for i, u in enumerate(units) if u.bound.keys() & done.bound.keys()), 0)
            done = join(done, units.pop(i))
        return done

    # -- property paths: tables of s and o (and g inside GRAPH ?g)
    def path(self, p, graph, s=("var", ""), o=("var", "")) -> DataFrame:
        extra = ["g"] if graph is not None and graph[0] == "var" else []
        swap = lambda df: df.select(F.col("o").alias("s"), F.col("s").alias("o"), *extra)
        kind = p[0]
        if kind == "iri":
            return self.active(graph, p[1]).select("s", "o", *extra)
        if kind == "inv":
            return swap(self.path(p[1], graph, o, s))
        if kind == "seq":
            a, b = self.path(p[1], graph, s), self.path(p[2], graph, ("var", ""), o)
            return a.select("s", F.col("o").alias("m"), *extra).join(b.select(F.col("s").alias("m"), "o", *extra), ["m", *extra]).select("s", "o", *extra)
        if kind == "alt":
            return self.path(p[1], graph, s, o).union(self.path(p[2], graph, s, o))
        if kind == "not":
            _, forward, backward = p
            quads = self.active(graph)
            ahead, back = quads.where(~F.col("p").isin(forward) if forward else F.lit(True)).select("s", "o", *extra), swap(quads.where(~F.col("p").isin(backward)).select("s", "o", *extra))
            return back if backward and not forward else ahead.union(back) if backward else ahead
        edges = self.path(p[1], graph)
        if kind == "+":
            return self.closure(edges, extra, s, o)
        nodes = self.active(graph)
        ends = nodes.select(F.col("s").alias("n"), *extra).union(nodes.select(F.col("o").alias("n"), *extra))
        if not extra:
            for t in (s, o):
                if t[0] != "var":
                    ends = ends.union(self.spark.createDataFrame([(t[1],)], "n string"))
        same = ends.select(F.col("n").alias("s"), F.col("n").alias("o"), *extra)
        for name, t in (("s", s), ("o", o)):
            if t[0] != "var":
                same = same.where(F.col(name) == t[1])
        return same.union(edges if kind == "?" else self.closure(edges, extra, s, o)).distinct()

    def closure(self, edges: DataFrame, extra: list[str], s, o) -> DataFrame:
        """One step or more; a constant end is where it starts."""
        swap = lambda df: df.select(F.col("o").alias("s"), F.col("s").alias("o"), *extra)
        if s[0] != "var":
            return Closure(edges, extra).onward_from(s[1])
        return swap(Closure(swap(edges), extra).onward_from(o[1])) if o[0] != "var" else Closure(edges, extra).pairs()

    # -- patterns
    def group(self, elements: list, graph, given: Solutions | None = None) -> tuple[Solutions, list]:
        """The solutions of a group before its FILTERs, and those."""
        now, filters = given or unit(self.spark), []
        empty = given is None
        for e in elements:
            kind = e[0]
            if kind == "filter":
                filters.append(e[1])
                continue
            if kind == "optional":
                now = self.optional(now, *self.group(e[1][1], graph), graph)
            elif kind == "minus":
                now = self.minus(now, self.pattern(e[1], graph))
            elif kind == "bind":
                now = self.extend(now, e[2], e[1], graph)
            else:
                made = self.pattern(e, graph)
                now = made if empty else join(now, made)
            empty = False
        return now, filters

    def pattern(self, e, graph) -> Solutions:
        kind = e[0]
        if kind == "bgp":
            return self.bgp(e[1], graph)
        if kind == "group":
            now, filters = self.group(e[1], graph)
            return self.filtered(now, filters, graph)
        if kind == "union":
            sides = [self.pattern(x, graph) for x in e[1]]
            return united(sides, list(dict.fromkeys(n for x in sides for n in x.bound)))
        if kind == "graph":
            if e[1][0] == "var":
                made = self.pattern(e[2], e[1])
                if e[1][1] not in made.bound:  # nothing inside touches the graph
                    names = self.active(e[1]).select(F.col("g").alias(column_name(e[1][1]))).distinct()
                    made = join(made, Solutions(names, {e[1][1]: True}))
                return made
            return self.pattern(e[2], e[1])
        if kind == "values":
            return self.values(e[1], e[2])
        if kind == "sub":
            inner = Engine(self.spark, self.store, self.services, self.functions, self.base)
            inner.graphs, inner.named = self.graphs, self.named
            return inner.solve(e[1], graph)
        if kind == "service":
            _, name, silent, inside = e
            store = self.services.get(name[1])
            if store is None:
                if silent:
                    return unit(self.spark)
                raise SparqlError("SPARQL-SERVICE-001", f"no service {name[1]}", 0)
            return Engine(self.spark, store, self.services, self.functions, self.base).pattern(inside, None)
        raise SparqlError("SPARQL-SYNTAX-001", f"unknown pattern {kind}", 0)

    def values(self, names: list[str], rows: list[list]) -> Solutions:
        schema = ", ".join(f"`{column_name(n)}` string" for n in names) or "x int"
        df = self.spark.createDataFrame([tuple(r) for r in rows] if names else [(1,)] * len(rows), schema)
        return Solutions(df if names else df.select(), {n: all(r[i] is not None for r in rows) for i, n in enumerate(names)})

    def optional(self, a: Solutions, b: Solutions, filters: list, graph=None) -> Solutions:
        a = self.told_apart(a, filters)
        shared = [n for n in a.bound if n in b.bound]
        names = list(dict.fromkeys([*a.bound, *b.bound]))
        if any(map(contains_exists, filters)):
            # Joined and filtered, then those of a that found nothing: what is found depends on their values alone.
            found = self.filtered(join(a.copied(list(a.bound)), b), filters, graph)
            return united([found, self.matching(a, found, list(a.bound), "left_anti")], names)
        apart = loose(a, b, shared)
        if apart and b.bound[apart]:
            return united([self.optional(x, b, filters, graph) for x in a.halves(apart)], names)

        def column(n: str) -> Value | Column | None:
            if n in a.bound and n in b.bound and not a.bound[n]:
                return F.coalesce(col(n), rcol(n))
            return a.column(n) if n in a.bound else rvalue(b, n) if n in b.bound else None

        condition = agreement(a, b, shared)
        for f in filters:
            condition &= F.coalesce(self.compiler(column, row_of(a))(f).truth, F.lit(False))
        return merged(a.df.join(renamed(b), condition, "left"), a, b, shared, inner=False)

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        shared = [n for n in a.bound if n in b.bound]
        if not shared:
            return a
        if apart := loose(a, b, shared):
            for y in b.halves(apart):  # what one part takes away the other needn't
                a = united([self.minus(x, y) for x in a.halves(apart)], list(a.bound)) if not a.bound[apart] else self.minus(a, y)
            return a
        return Solutions(a.df.join(renamed(b), agreement(a, b, shared), "left_anti"), a.bound, a.natives)

    def matching(self, a: Solutions, found: Solutions, names: list[str], how: str) -> Solutions:
        """The solutions of a whose values of some variables are (or are not) among the copies of these."""
        own = found.df.select(*(col(copy(n)) for n in names)).distinct()
        return Solutions(a.df.join(own, same_copies(names), how), a.bound, a.natives)

    def compiler(self, column: Callable[[str], Column | None], row: str | None = None) -> Compiler:
        return Compiler(column, self.base, None if row is None else col(row), self.functions)

    def of(self, a: Solutions) -> Compiler:
        """Compiles expressions over solutions."""
        return self.compiler(a.column, row_of(a))

    def told_apart(self, a: Solutions, expressions) -> Solutions:
        """The solutions, told apart where an expression makes blank nodes that a solution shares."""
        return numbered(a) if row_of(a) is None and names_nodes(expressions) else a

    def extend(self, a: Solutions, name: str, e, graph=None) -> Solutions:
        if name in a.bound:
            raise SparqlError("SPARQL-BIND-001", f"?{name} is already in scope", 0)
        a = self.told_apart(a, e)
        b, e = self.lifted(*self.flagged(a, e, graph))
        made = b.df.withColumn(column_name(name), self.of(b)(e).term)
        certain = e[0] in ("lit", "iri") or e[0] == "var" and a.bound.get(e[1], False)
        return Solutions(made.drop(*(column_name(n) for n in b.bound if n not in a.bound)), {**a.bound, name: certain}, a.natives)

    def lifted(self, a: Solutions, e) -> tuple[Solutions, tuple]:
        """Arguments that are calls of calls become columns of their own: functions name their arguments many times, and would grow by powers."""

        def walk(e):
            nonlocal a
            if not isinstance(e, (tuple, list)) or e[:1] in (("exists",), ("agg",), ("column",)):
                return e
            made = [walk(x) for x in e]
            if e[:1] in (("fn",), ("call",)):
                for i, x in enumerate(made[2]):
                    if depth(x) > 1:
                        name = f".l{len(a.df.columns)}"
                        a = Solutions(a.df.withColumn(column_name(name), self.of(a)(x).term), {**a.bound, name: False}, a.natives)
                        made[2][i] = ("var", name)
            return tuple(made) if isinstance(e, tuple) else made

        e = walk(e)
        return a, e

    def filtered(self, a: Solutions, filters: list, graph) -> Solutions:
        for f in (part for x in filters for part in conjuncts(x)):
            if f[0] == "exists" or f[0] == "not" and f[1][0] == "exists":
                negated = f[2] if f[0] == "exists" else not f[1][2]
                a = self.exists(a, f if f[0] == "exists" else f[1], graph, "left_anti" if negated else "left_semi")
            else:
                a = self.told_apart(a, f)
                b, g = self.lifted(*self.flagged(a, f, graph))
                b = b.where(self.of(b)(g).truth)
                a = Solutions(b.df.drop(*(column_name(n) for n in b.bound if n not in a.bound)), a.bound, a.natives)
        return a

    def exists(self, a: Solutions, e, graph, how: str) -> Solutions:
        """Solutions with (or without) a compatible one inside; FILTERs there may mean outer variables."""
        a = self.told_apart(a, e)
        b, filters = self.group(e[1][1], graph)
        shared = [n for n in a.bound if n in b.bound]
        outer = [f for f in filters if names_in(f) - b.bound.keys()]
        b = self.filtered(b, [f for f in filters if f not in outer], graph)
        if any(map(contains_exists, outer)):
            # An EXISTS within that means variables from without: told once for each of their values.
            names = [n for n in a.bound if n in b.bound or any(n in names_in(f) for f in outer)]
            keys = a.keep(names)
            keys = Solutions(keys.df.distinct(), keys.bound).copied(names)
            return self.matching(a, self.filtered(join(keys, b), outer, graph), names, how)
        apart = loose(a, b, shared)
        if apart and b.bound[apart]:
            return united([self.exists(x, e, graph, how) for x in a.halves(apart)], list(a.bound))
        condition = agreement(a, b, shared)

        def column(n: str) -> Value | Column | None:
            return rvalue(b, n) if n in b.bound else a.column(n)

        for f in outer:
            condition &= F.coalesce(self.compiler(column, row_of(a))(f).truth, F.lit(False))
        return Solutions(a.df.join(renamed(b), condition, how), a.bound, a.natives)

    def flagged(self, a: Solutions, e, graph):
        """An expression whose EXISTS have become truth columns."""
        if not contains_exists(e):
            return a, e
        if e[0] == "exists":
            # Told for each of the values that it may depend on, so equal solutions stay as many as they are.
            names = [n for n in a.bound if n in names_in(e[1])]
            flag = f"f_{len(a.df.columns)}"
            if not names:
                found = self.exists(unit(self.spark), e, graph, "left_semi").df.agg((F.count(F.lit(1)) > 0).alias(flag))
                hit = a.df.crossJoin(F.broadcast(found))
            else:
                keys = a.keep(names)
                found = self.exists(Solutions(keys.df.distinct(), keys.bound), e, graph, "left_semi").df.select(*(col(n).alias(column_name(copy(n))) for n in names), F.lit(True).alias(flag))
                hit = a.df.join(found, same_copies(names), "left").drop(*(column_name(copy(n)) for n in names))
            truth = F.coalesce(F.col(flag), F.lit(False))
            return Solutions(hit, a.bound, a.natives), ("column", Value(truth=~truth if e[2] else truth))
        parts = []
        for x in e:
            if isinstance(x, tuple):
                a, x = self.flagged(a, x, graph)
            elif isinstance(x, list):
                own = []
                for y in x:
                    a, y = self.flagged(a, y, graph)
                    own.append(y)
                x = own
            parts.append(x)
        return a, tuple(parts)

    # -- solution modifiers
    def solve(self, q: Query, graph=None) -> Solutions:
        now = self.pattern(q.where, graph) if q.where else unit(self.spark)
        if q.values:
            now = join(now, self.values(*q.values))
        names = [n for n, _ in q.project] if q.project is not None else [n for n in now.bound if not n.startswith(".")]
        project, having, order = list(q.project or []), list(q.having), list(q.order)
        if q.group is not None or any(e is not None and has_aggregate(e) for _, e in project) or any(map(has_aggregate, having)) or any(has_aggregate(e) for e, _ in order):
            now, project, having, order = self.aggregate(now, q.group, project, having, order, graph)
        for name, e in project:
            if e is not None:
                now = self.extend(now, name, e, graph)
        now = self.filtered(now, having, graph)
        ordered = lambda s: s.df.orderBy(*(F.desc(k) if down else F.asc(k) for k, down in ((order_key(self.of(s)(e)), down) for e, down in order)))
        if q.distinct:
            now = now.keep(names)
            now = Solutions(now.df.distinct(), now.bound)
        if order:
            now = self.told_apart(now, order)
            now = Solutions(ordered(now), now.bound)
        now = now.keep(names)
        df = now.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, now.bound)

    def aggregate(self, a: Solutions, group, project, having, order, graph):
        keys, swaps = [], []
        for i, (name, e) in enumerate(group or []):
            if e is not None:
                key = name or f".k{i}"
                a = self.extend(a, key, e, graph)
                swaps.append((e, ("var", key)))
                keys.append(key)
            else:
                keys.append(name)
        a = self.told_apart(a, [project, having, order])
        made: list[Column] = []
        values: dict = {}
        compile_ = self.of(a)
        held = [k for k in keys if k in a.bound]
        by = [col(k) for k in held]
        apart: list[DataFrame] = []  # sums over a group's distinct terms, each of its own

        def distinct_sum(e) -> Value:
            """Terms are made distinct before they are summed, so no group is gathered in one row."""
            terms = a.df.select(*by, compile_(e[3]).term.alias("x_term")).distinct()
            own: list[Column] = []
            value = self.one_aggregate(("agg", e[1], False, ("var", "x"), e[4]), self.compiler(lambda _: F.col("x_term")), [], own, f"d{len(apart)}")
            apart.append((terms.groupBy(*by) if group is not None else terms.groupBy()).agg(*own))
            return value

        def lift(e):
            for old, new in swaps:
                if e == old:
                    return new
            if isinstance(e, tuple) and e and e[0] == "agg":
                if str(e) not in values:
                    values[str(e)] = distinct_sum(e) if e[2] and e[1] in ("SUM", "AVG") else self.one_aggregate(e, compile_, [n for n in a.bound if not n.startswith(".")], made)
                return "column", values[str(e)]
            if isinstance(e, tuple):
                return tuple(lift(x) if isinstance(x, (tuple, list)) else x for x in e)
            return [lift(x) if isinstance(x, (tuple, list)) else x for x in e] if isinstance(e, list) else e

        project = [(n, None if e is None else lift(e)) for n, e in project]
        having, order = [lift(e) for e in having], [(lift(e), down) for e, down in order]
        for n, e in project:
            if e is None and n not in keys:
                raise SparqlError("SPARQL-AGG-001", f"?{n} is neither grouped nor aggregated", 0)
        made = made or [F.count(F.lit(1)).alias("n_all")]
        df = a.df.groupBy(*by).agg(*made) if group is not None else a.df.agg(*made)
        for x in apart:
            own = x.select(*(col(k).alias(column_name(copy(k))) for k in held), *(F.col(c) for c in x.columns if c not in {column_name(k) for k in held}))
            df = (df.join(own, same_copies(held)) if held else df.crossJoin(own)).drop(*(column_name(copy(k)) for k in held))
        return Solutions(df, {k: a.bound[k] for k in held}), project, having, order

    def one_aggregate(self, e, compile_: Compiler, names: list[str], made: list[Column], mark: str = "a") -> Value:
        """The value of an aggregate over columns that are added to made."""
        _, name, distinct, inside, separator = e

        def add(c: Column) -> Column:
            made.append(c.alias(f"{mark}_{len(made)}"))
            return F.col(f"{mark}_{len(made) - 1}")

        if inside is None:
            return whole(add(F.count_distinct(F.struct(*(F.coalesce(col(n), F.lit("")) for n in names))) if distinct and names else F.count(F.lit(1))))
        v = compile_(inside)
        t = v.term
        if name == "COUNT":
            return whole(add(F.count_distinct(t) if distinct else F.count(t)))
        if name == "SAMPLE":
            return Value(add(F.min(t)))
        if name in ("MIN", "MAX"):
            key = F.when(t.isNotNull(), order_key(v))
            best = add((F.min if name == "MIN" else F.max)(key))
            return Value(best.getField("term"))
        if name == "GROUP_CONCAT":
            own = F.when(T.is_iri(t), T.iri_text(t)).otherwise(text(v))
            if not distinct:
                return Value(T.string(F.array_join(F.sort_array(add(F.collect_list(own))), separator)))
            got = add(F.collect_set(F.when(own.isNotNull(), F.struct(own.alias("text"), t.alias("term")))))  # different terms of one text are two
            return Value(T.string(F.array_join(F.transform(F.sort_array(got), lambda x: x["text"]), separator)))
        rank, dec, dbl, big = v.number
        # A number without its value is an error, as is whatever is none.
        rank = F.when(F.when(rank == 1, big.isNotNull()).when(rank == 2, dec.isNotNull()).otherwise(dbl.isNotNull()), rank)
        zero, none = F.lit(0).cast("decimal(38,18)"), F.lit(0).cast("decimal(38,0)")
        n, bad = add(F.count(F.lit(1))), add(F.count(F.when(rank.isNull(), 1))) > 0
        top, real = add(F.max(rank)), add(F.sum(dbl))
        # What is too long for a decimal leaves none.
        total = F.when(add(F.count(F.when(dec.isNull(), 1))) == 0, add(F.try_sum(dec)).try_cast("decimal(38,18)"))
        integer = add(F.try_sum(big)).try_cast("decimal(38,0)")
        if name == "SUM":
            r = F.when(n == 0, 1).when(~bad, top)
            made = total, real, integer
        else:
            r = F.when(n == 0, 1).when(~bad, F.greatest(top, F.lit(2)))
            mean = lambda x: F.try_divide(x, n).try_cast("decimal(38,18)")
            made = F.coalesce(mean(total), F.when(top == 1, mean(integer))), F.try_divide(real, n), no_whole()
        dec, dbl, big = (F.when(n == 0, x).when(~bad, y) for x, y in zip((zero, F.lit(0.0), none), made, strict=True))
        return Value(number=Number(r, dec, dbl, big))

    # -- forms
    def query(self, q: Query | str) -> DataFrame:
        if isinstance(q, str):
            q = parse_query(q, self.base)
        self.graphs, self.named = q.graphs, q.named
        if q.form == "SELECT":
            done = self.solve(q)
            return done.df.select(*(col(n) for n in done.bound)).toDF(*done.bound)
        if q.form == "ASK":
            return self.pattern(q.where, None).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if q.form == "CONSTRUCT":
            return self.construct(self.solve(Query("SELECT", q.where, None, order=q.order, limit=q.limit, offset=q.offset, values=q.values)), [(*t, None) for t in q.template]).select("s", "p", "o").distinct()
        return self.describe(q)

    def construct(self, a: Solutions, template: list[tuple], fresh: str = "") -> DataFrame:
        """Quads of a template, one blank node for each solution and label; ill-formed ones are left out. fresh: sets these nodes apart from others."""
        if not template:
            return self.spark.createDataFrame([], "s string, p string, o string, g string")
        if any(t and t[0] == "var" and t[1].startswith(".") for quad in template for t in quad):
            a = numbered(a)  # what told them apart within the pattern may have been joined with others since
        row = next((n for n in reversed(a.bound) if n.startswith(ROW)), None)

        def term(t) -> Column:
            if t is None:
                return F.lit(None).cast("string")
            if t[0] == "path":
                t = t[1]
            if t[0] != "var":
                return F.lit(t[1])
            if t[1] in a.bound:
                return col(t[1])
            if t[1].startswith("."):
                return F.concat(F.lit("_:b"), F.md5(F.concat(col(row), F.lit(f" {fresh} {t[1]}")).cast("binary")))
            return F.lit(None).cast("string")

        quads = F.array(*(F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o"), term(g).alias("g"), F.lit(g is not None).alias("named")) for s, p, o, g in template))
        df = a.df.select(F.explode(quads).alias("q")).select("q.*")
        good = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & ~T.is_literal(F.col("s")) & T.is_iri(F.col("p")) & (~F.col("named") | F.col("g").isNotNull())
        return df.where(good).drop("named").distinct()

    def describe(self, q: Query) -> DataFrame:
        """Facts whose subject is described, with those of the blank nodes they lead to."""
        constants = [t[1] for t in q.describe if t[0] == "iri"]
        wanted = self.spark.createDataFrame([(c,) for c in constants], "s string")
        if q.where:
            a = self.solve(Query("SELECT", q.where, None, order=q.order, limit=q.limit, offset=q.offset))
            for n in [t[1] for t in q.describe if t[0] == "var"] or ([] if q.describe else list(a.bound)):
                if n in a.bound:
                    wanted = wanted.union(a.df.select(col(n).alias("s")).where(~T.is_literal(F.col("s"))))
        facts = self.active(None)
        now = written(facts.join(wanted.distinct(), "s", "left_semi"))
        front = now
        while True:
            nodes = front.where(T.is_bnode(F.col("o"))).select(F.col("o").alias("s")).distinct().join(now.select("s").distinct(), "s", "left_anti")
            front = written(facts.join(nodes, "s", "left_semi"))
            if front.isEmpty():
                return now
            now = written(now.union(front).distinct())


def same_copies(names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [col(n).eqNullSafe(col(copy(n))) for n in names], F.lit(True))


def depth(e) -> int:
    """How deep calls stand in calls."""
    if not isinstance(e, (tuple, list)) or e[:1] in (("exists",), ("agg",), ("column",)):
        return 0
    return max(map(depth, e), default=0) + (e[:1] in (("fn",), ("call",)))


def conjuncts(e) -> list:
    return conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


def names_nodes(e) -> bool:
    """Whether an expression has a BNODE of a text, which a solution makes but once."""
    return isinstance(e, (tuple, list)) and (e[:1] == ("fn",) and e[1] == "BNODE" and len(e[2]) > 0 or any(map(names_nodes, e)))


def contains_exists(e) -> bool:
    return isinstance(e, (tuple, list)) and (e[:1] == ("exists",) or any(contains_exists(x) for x in e))


def names_in(e) -> set[str]:
    """The variables of a piece of syntax, whatever it is."""
    if isinstance(e, Query):
        return names_in([e.where, e.project or [], e.values or [], e.group or [], e.having, e.order]) | {n for n, _ in e.project or []}
    if isinstance(e, tuple) and e[:1] == ("var",):
        return {e[1]}
    return set().union(*(names_in(x) for x in e)) if isinstance(e, (tuple, list)) else set()


def sparql(spark: SparkSession, store, text: str, services: dict | None = None, functions: dict | None = None, base: str | None = None) -> DataFrame:
    """The result of a query: a column of canonical terms for each variable, s, p and o, or answer."""
    return Engine(spark, store, services, functions, base).query(text)


__all__ = ["Engine", "Solutions", "sparql", "visible"]
