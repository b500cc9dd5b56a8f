"""SPARQL Update: a base of facts with what operations have added to it and taken from it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .mapping import QUAD, Facts
from .sparql import Engine
from .sparql_parser import SparqlError, parse_update


#: Operations after which the base is written anew, and rows of a base that are not worth it.
MERGE, LEAST = 50, 1000


def same_quads(facts: DataFrame, others: DataFrame, how: str) -> DataFrame:
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "g" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in QUAD]
    return facts.alias("a").join(others.alias("b"), same[0] & same[1] & same[2] & same[3], how)


def without(facts: DataFrame, gone: DataFrame) -> DataFrame:
    return same_quads(facts, gone, "left_anti")


class Updater:
    """facts: s, p, o, g. graphs: known names, of which some may be empty. load: IRI -> facts.

    The store is a written base, less graphs that have been cleared and quads that have been removed, and with added quads beside it that the
    base hasn't. An operation writes what it adds and removes, never the base; what has gathered is merged into a new base once it is a
    quarter of it, or after MERGE operations, so plans stay as small as they begin. Data told in the request are gathered by quad first,
    the last word on each counting.
    """

    def __init__(self, spark: SparkSession, facts: DataFrame, load: Callable[[str], DataFrame] | None = None, functions: dict | None = None):
        self.spark, self.load, self.functions = spark, load, functions
        self.created: set[str] = set()
        self.told: dict[tuple, bool] = {}  # quad -> whether it is there, of data operations since the last other one
        self._rest(written(facts.select(*QUAD).distinct()))

    def _rest(self, base: DataFrame) -> None:
        self.base, self.size, self.steps = base, base.count(), 0
        self.cleared: list[Column] = []  # conditions of what is left of the base
        self.added: DataFrame | None = None
        self.removed: DataFrame | None = None

    def left(self) -> DataFrame:
        """What is left of the base."""
        df = reduce(lambda x, c: x.where(c), self.cleared, self.base)
        return df if self.removed is None else without(df, self.removed)

    @property
    def facts(self) -> DataFrame:
        return self.left() if self.added is None else self.left().unionByName(self.added)

    def change(self, gone: DataFrame | None, new: DataFrame | None) -> None:
        """Takes quads away, then adds others."""
        kept = self.added
        if gone is not None:
            gone = written(gone.select(*QUAD).distinct())
            kept = kept and without(kept, gone)
            self.removed = gone if self.removed is None else written(self.removed.union(gone).distinct())
        if new is not None:
            new = written(new.select(*QUAD).distinct())
            new = without(new, same_quads(self.left(), new, "left_semi"))
            kept = new if kept is None else kept.unionByName(new).distinct()
        self.added = kept if kept is None else written(kept)
        self._stepped()

    def _stepped(self) -> None:
        self.steps += 1
        beside = sum(df.count() for df in (self.added, self.removed) if df is not None)
        if self.steps >= MERGE or 4 * beside > max(self.size, LEAST):
            self._rest(written(self.facts))

    def clear(self, keep: Column) -> None:
        """Leaves those quads alone that a condition holds for."""
        self.cleared.append(keep)
        self.added = self.added and written(self.added.where(keep))
        self._stepped()

    def tell(self) -> None:
        """Brings data operations to the store."""
        if self.told:
            made = {there: [q for q, x in self.told.items() if x == there] for there in (False, True)}
            gone, new = (self.spark.createDataFrame(made[x], ", ".join(f"{c} string" for c in QUAD)) if made[x] else None for x in (False, True))
            self.told = {}
            self.change(gone, new)

    def run(self, text: str, base: str | None = None) -> DataFrame:
        for op in parse_update(text, base):
            if op[0] not in ("insert data", "delete data"):
                self.tell()
            self.one(op, base)
        self.tell()
        return self.facts

    def known(self, graph: str | None) -> bool:
        return graph is None or graph in self.created or not self.facts.where(F.col("g") == graph).isEmpty()

    def of(self, graph: str | None):
        return F.col("g").isNull() if graph is None else F.col("g").eqNullSafe(F.lit(graph))

    def put(self, more: DataFrame, graph: str | None) -> None:
        self.change(None, more.withColumn("g", F.lit(graph).cast("string")))

    def one(self, op: tuple, base: str | None) -> None:
        kind = op[0]
        if kind in ("insert data", "delete data"):
            fresh = uuid.uuid4().hex  # of which the blank nodes of this operation have their labels

            def term(t) -> str | None:
                t = t[1] if t and t[0] == "path" else t
                return t and (f"_:b{fresh}{t[1][1:]}" if t[0] == "var" else t[1])

            for quad in op[1]:
                s, p, o, g = map(term, quad)
                if not s.startswith('"') and p.startswith("<"):
                    self.told[s, p, o, g] = kind == "insert data"
        elif kind == "modify":
            self.modify(*op[1:], base)
        elif kind in ("clear", "drop"):
            which, silent = op[1], op[2]
            if which in ("DEFAULT", "NAMED", "ALL"):
                self.clear({"DEFAULT": F.col("g").isNotNull(), "NAMED": F.col("g").isNull(), "ALL": F.lit(False)}[which])
                self.created -= self.created if which != "DEFAULT" and kind == "drop" else set()
            else:
                if not silent and not self.known(which):
                    raise SparqlError("SPARQL-GRAPH-001", f"no graph {which}", 0)
                self.clear(~self.of(which))
                if kind == "drop":
                    self.created.discard(which)
                else:
                    self.created.add(which)
        elif kind == "create":
            if not op[2] and self.known(op[1]):
                raise SparqlError("SPARQL-GRAPH-001", f"{op[1]} exists", 0)
            self.created.add(op[1])
        elif kind in ("copy", "move", "add"):
            _, source, target, silent = op
            if source == target:
                return
            if not self.known(source):
                if silent:
                    return
                raise SparqlError("SPARQL-GRAPH-001", f"no graph {source}", 0)
            moved = written(self.facts.where(self.of(source)).select("s", "p", "o"))
            if kind != "add":
                self.clear(~self.of(target) & ~self.of(source) if kind == "move" else ~self.of(target))
            self.put(moved, target)
            if kind == "move":
                self.created.discard(source or "")
        elif kind == "load":
            _, source, into, silent = op
            try:
                if self.load is None:
                    raise SparqlError("SPARQL-LOAD-001", "nothing can be loaded here", 0)
                self.put(self.load(source[1:-1]).select("s", "p", "o"), into)
            except (PySparkException, ValueError, OSError):
                if not silent:
                    raise

    def modify(self, delete: list, insert: list, with_, using: list, named: list, where, base: str | None) -> None:
        engine = Engine(self.spark, Facts(self.facts), None, self.functions, base)
        engine.graphs, engine.named = using, named
        found = engine.pattern(where, ("iri", with_) if with_ and not using and not named else None)
        found = found.keep([n for n in found.bound if not n.startswith(".")])  # blank nodes of the pattern are none of the template
        found.df = written(found.df) if found.df.columns else found.df
        scoped = lambda quads: [(*q[:3], q[3] or (("iri", with_) if with_ else None)) for q in quads]
        gone, new = engine.construct(found, scoped(delete)), engine.construct(found, scoped(insert), uuid.uuid4().hex)
        self.change(gone if delete else None, new if insert else None)


def update(spark: SparkSession, facts: DataFrame, text: str, load: Callable[[str], DataFrame] | None = None, base: str | None = None) -> DataFrame:
    return Updater(spark, facts, load).run(text, base)
