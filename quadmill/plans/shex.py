"""ShEx compact syntax: parsing, facts of a schema, and validation of focus nodes as DataFrame plans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.iri import resolve_text
from ..session import written
from . import bags
from .sparql_parser import LOCAL, PN, RDF, XSD, Words, fold_tag, quote, typed

TOKEN = re.compile(
    rf"""(?P<skip>(?:\s+|\#[^\n]*|/\*.*?\*/)+)
    |(?P<iri><[^\x00-\x20<>"{{}}|^`\\]*>)
    |(?P<str>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)+(?=[\s\]])|@(?:en|de|fr|es)(?=[\s\]]))
    |(?P<bnode>_:[A-Za-z0-9_]+)
    |(?P<num>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<pname>(?:{PN})?:(?:{LOCAL})?)
    |(?P<word>[A-Za-z][A-Za-z0-9_]*)
    |(?P<op>\^\^|[{{}}()\[\]|;,.@*+?~$&^!=-])""",
    re.X | re.S,
)
WORDS = Words(TOKEN)
KINDS = {"IRI": "iri", "LITERAL": "literal", "NONLITERAL": "nonliteral", "BNODE": "bnode"}
SPACE = "urn:x-shex-syntax:"
MANY = bags.MANY


class ShexError(ValueError):
    def __init__(self, code: str, message: str, at: int = 0):
        super().__init__(f"{code}: {message} at {at}")
        self.code, self.at = code, at


@dataclass
class Shape:
    expression: tuple | None = None
    closed: bool = False
    extra: list[str] = field(default_factory=list)
    extends: list[str] = field(default_factory=list)


@dataclass
class Schema:
    shapes: dict[str, tuple] = field(default_factory=dict)
    abstract: set[str] = field(default_factory=set)
    start: tuple | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    base: str | None = None
    labels: dict[str, tuple] = field(default_factory=dict)


class Parser:
    """Shape expressions: ("kind", k), ("datatype", iri), ("values", [...]), ("ref", label), ("and"|"or", [...]), ("not", e), ("any",), ("shape", Shape).

    Triple expressions: ("each"|"one", [...], low, high), ("constraint", inverse, predicate, shape expression or None, low, high), ("include", label).
    """

    def __init__(self, text: str, base: str | None = None):
        self.schema = Schema(base=base)
        self.pieces, at = WORDS.cut(text)
        if at < len(text):
            raise ShexError("SHEX-SYNTAX-001", f"unexpected {text[at]!r}", at)
        self.tokens = WORDS.tokens(self.pieces)
        self.i = 0

    def fail(self, message: str):
        raise ShexError("SHEX-SYNTAX-001", f"{message}, found {self.tokens[self.i][1]!r}", WORDS.offset(self.pieces, self.i))

    def op(self, *s: str) -> str | None:
        key = self.tokens[self.i][2]
        if key in s:
            self.i += 1
            return key
        return None

    def need(self, s: str) -> None:
        if not self.op(s):
            self.fail(f"expected {s!r}")

    word = op

    def iri(self) -> str | None:
        kind, text, _ = self.tokens[self.i]
        if kind == "iri":
            self.i += 1
            return f"<{resolve_text(self.schema.base, text[1:-1]) if self.schema.base else text[1:-1]}>"
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.schema.prefixes:
                self.fail(f"undeclared prefix {prefix!r}")
            self.i += 1
            return f"<{self.schema.prefixes[prefix]}{local}>"
        if kind == "word" and text == "a":
            self.i += 1
            return f"<{RDF}type>"
        return None

    def label(self) -> str | None:
        kind, text, _ = self.tokens[self.i]
        if kind == "bnode":
            self.i += 1
            return text
        return self.iri()

    def parse(self) -> Schema:
        while self.tokens[self.i][0] != "end":
            if self.word("BASE"):
                self.schema.base = self.iri()[1:-1]  # type: ignore[index]
            elif self.word("PREFIX"):
                kind, text, _ = self.tokens[self.i]
                if kind != "pname" or not text.endswith(":"):
                    self.fail("expected a prefix")
                self.i += 1
                self.schema.prefixes[text[:-1]] = (self.iri() or self.fail("expected an IRI"))[1:-1]
            elif self.word("START"):
                self.need("=")
                self.schema.start = self.shape_expression()
            else:
                abstract = bool(self.word("ABSTRACT"))
                name = self.label() or self.fail("expected a shape")
                self.schema.shapes[name] = self.shape_expression()
                if abstract:
                    self.schema.abstract.add(name)
        return self.schema

    def shape_expression(self) -> tuple:
        parts = [self.conjunction()]
        while self.word("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def conjunction(self) -> tuple:
        parts = [self.negation()]
        while True:
            if self.word("AND"):
                parts.append(self.negation())
            elif parts[-1][0] in ("kind", "datatype", "values") and (self.tokens[self.i][1] in ("{", "CLOSED", "EXTRA", "@") and self.tokens[self.i][0] in ("op", "word") and self.tokens[self.i + 1][0] != "num"):
                parts.append(self.negation())  # a node constraint and a shape without AND between
            else:
                return parts[0] if len(parts) == 1 else ("and", parts)

    def negation(self) -> tuple:
        return ("not", self.atom()) if self.word("NOT") else self.atom()

    def atom(self) -> tuple:
        if self.op("("):
            e = self.shape_expression()
            self.need(")")
            return e
        if self.op("@"):
            return "ref", self.label() or self.fail("expected a shape")
        kind, text, _ = self.tokens[self.i]
        if self.op("."):
            return ("any",)
        if k := self.word(*KINDS):
            return "kind", KINDS[k]
        if self.op("["):
            return "values", self.value_set()
        if kind == "op" and text == "{" or kind == "word" and text.upper() in ("CLOSED", "EXTRA", "EXTENDS"):
            return "shape", self.shape()
        iri = self.iri()
        if iri:
            return "datatype", iri
        return self.fail("expected a shape expression")

    def value_set(self) -> list[tuple]:
        out: list[tuple] = []
        while not self.op("]"):
            kind, text, _ = self.tokens[self.i]
            if kind == "str":
                self.i += 1
                n = 3 if text[:3] == '"""' else 1
                value = re.sub(r"\\(.)", r"\1", text[n:-n], flags=re.S)
                k2, t2, _ = self.tokens[self.i]
                if k2 == "lang":
                    self.i += 1
                    out.append(("term", f"{quote(value)}@{fold_tag(t2[1:])}"))
                elif self.op("^^"):
                    out.append(("term", typed(value, (self.iri() or self.fail("expected a datatype"))[1:-1])[1]))
                else:
                    out.append(("term", quote(value)))
            elif kind == "num":
                self.i += 1
                out.append(("term", typed(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))[1]))
            elif kind == "word" and text in ("true", "false"):
                self.i += 1
                out.append(("term", typed(text, XSD + "boolean")[1]))
            elif kind == "lang":
                self.i += 1
                out.append(("language", text[1:].lower()))
            elif iri := self.iri():
                out.append(("stem", iri[1:-1]) if self.op("~") else ("term", iri))
            else:
                self.fail("expected a value")
        return out

    def shape(self) -> Shape:
        s = Shape()
        while True:
            if self.word("CLOSED"):
                s.closed = True
            elif self.word("EXTRA"):
                while iri := self.iri():
                    s.extra.append(iri)
            elif self.word("EXTENDS"):
                self.op("@")
                s.extends.append(self.label() or self.fail("expected a shape"))
            else:
                break
        self.need("{")
        s.expression = None if self.tokens[self.i][1] == "}" else self.one_of()
        self.need("}")
        return s

    def one_of(self) -> tuple:
        parts = [self.each_of()]
        while self.op("|"):
            parts.append(self.each_of())
        return parts[0] if len(parts) == 1 else ("one", parts, 1, 1)

    def each_of(self) -> tuple:
        parts = [self.unary()]
        while self.op(";", ","):
            if self.tokens[self.i][1] in ("}", ")", "|"):
                break
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else ("each", parts, 1, 1)

    def cardinality(self) -> tuple[int, int]:
        if o := self.op("?", "*", "+"):
            return {"?": (0, 1), "*": (0, MANY), "+": (1, MANY)}[o]
        if self.op("{"):
            low = int(self.tokens[self.i][1])
            self.i += 1
            high = low
            if self.op(","):
                high = MANY
                if self.tokens[self.i][0] == "num":
                    high = int(self.tokens[self.i][1])
                    self.i += 1
                else:
                    self.op("*")
            self.need("}")
            return low, high
        return 1, 1

    def unary(self) -> tuple:
        name = None
        if self.op("$"):
            name = self.label() or self.fail("expected a label")
        if self.op("&"):
            return "include", self.label() or self.fail("expected a label")
        if self.op("("):
            e = self.one_of()
            self.need(")")
            low, high = self.cardinality()
            e = e if (low, high) == (1, 1) else ("each", [e], low, high)
        else:
            inverse = bool(self.op("^")) or bool(self.word("INVERSE"))
            p = self.iri() or self.fail("expected a predicate")
            value = self.shape_expression()
            low, high = self.cardinality()
            e = ("constraint", inverse, p, None if value == ("any",) else value, low, high)
        if name:
            self.schema.labels[name] = e
        return e


def parse_shex(text: str, base: str | None = None) -> Schema:
    return Parser(text, base).parse()


def encode_shex(text: str) -> list[tuple[str, str, str, None]]:
    """The schema's shapes and constraints as facts."""
    schema, out, n = parse_shex(text), [], 0
    top = f"<{SPACE}schema>"

    def say(s: str, p: str, o: str) -> None:
        out.append((s, f"<{SPACE}{p}>", o, None))

    def shape(s: str, e: tuple) -> None:
        if e[0] in ("and", "or"):
            for x in e[1]:
                shape(s, x)
        elif e[0] == "not":
            shape(s, e[1])
        elif e[0] == "shape":
            if e[1].closed:
                say(s, "shape/closed", '"true"')
            for x in e[1].extends:
                say(s, "shape/extends", x)
            if e[1].expression:
                triples(s, e[1].expression)
        else:
            say(s, "nodeConstraint", quote(describe(e)))

    def triples(s: str, e: tuple) -> None:
        nonlocal n
        if e[0] in ("each", "one"):
            for x in e[1]:
                triples(s, x)
        elif e[0] == "constraint":
            n += 1
            node = f"_:.{n}"
            say(s, "shape/tripleConstraint", node)
            say(node, "tc/predicate", e[2])
            if e[1]:
                say(node, "tc/inverse", '"true"')
            say(node, "tc/cardinality", quote(f"{e[4]},{'*' if e[5] == MANY else e[5]}"))
            if e[3]:
                say(node, "tc/valueConstraint", quote(describe(e[3])))

    if schema.base:
        say(top, "base", quote(schema.base))
    for name, ns in schema.prefixes.items():
        say(top, "prefix", quote(f"{name}: <{ns}>"))
    for name, e in schema.shapes.items():
        say(top, "shape", name)
        shape(name, e)
    return out  # type: ignore[return-value]


def describe(e: tuple) -> str:
    if e[0] in ("and", "or"):
        return f" {e[0].upper()} ".join(describe(x) for x in e[1])
    if e[0] == "not":
        return "NOT " + describe(e[1])
    if e[0] == "values":
        return "[" + " ".join(v for _, v in e[1]) + "]"
    return e[1] if e[0] in ("datatype", "kind") else "@" + e[1] if e[0] == "ref" else "."


# -- validation


def node_test(e: tuple, t: Column) -> Column:
    """A node constraint as a truth column."""
    if e[0] == "any":
        return F.lit(True)
    if e[0] == "kind":
        return {"iri": T.is_iri(t), "literal": T.is_literal(t), "bnode": T.is_bnode(t), "nonliteral": ~T.is_literal(t)}[e[1]]
    if e[0] == "datatype":
        name = e[1][1:-1]
        same = F.coalesce(T.datatype(t) == name, F.lit(False))
        if name in (XSD + x for x in (*T.INTEGERS, "decimal", "float", "double")):
            return same & T.numeric_rank(t).isNotNull()
        if name == XSD + "boolean":
            return same & T.to_boolean(t).isNotNull()
        return same & T.to_timestamp(t).isNotNull() if name == XSD + "dateTime" else same
    tests = []
    terms = [v for k, v in e[1] if k == "term"]
    if terms:
        tests.append(t.isin(terms))
    tests += [T.is_iri(t) & F.startswith(T.iri_text(t), F.lit(v)) for k, v in e[1] if k == "stem"]
    tests += [F.coalesce(F.lower(T.language(t)) == v, F.lit(False)) for k, v in e[1] if k == "language"]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


class Validator:
    """Which nodes conform to which shapes, over facts s, p, o.

    Shapes that refer to each other are a greatest fixpoint: all nodes conform at first, and each round takes
    away those that don't. Nodes' counts of each constraint come from one aggregation a shape.
    """

    def __init__(self, schema: Schema, facts: DataFrame, nodes: DataFrame):
        self.schema, self.facts = schema, facts.select("s", "p", "o")
        self.nodes = nodes.select("node").distinct()
        self.good: dict[str, DataFrame] = {}

    def references(self, e, seen: set[str]) -> set[str]:
        if isinstance(e, Shape):
            for x in e.extends:
                seen.add(x)
            e = e.expression
        if isinstance(e, tuple):
            if e[0] == "ref":
                seen.add(e[1])
            for x in e[1:]:
                if isinstance(x, (tuple, list, Shape)):
                    self.references(x, seen)
        elif isinstance(e, list):
            for x in e:
                self.references(x, seen)
        return seen

    def everything(self) -> DataFrame:
        f = self.facts
        return f.select(F.col("s").alias("node")).union(f.select(F.col("o").alias("node"))).union(self.nodes).distinct()

    def conforming(self, label: str) -> DataFrame:
        """The focus nodes that conform to a shape."""
        need, todo = {label}, [label]
        while todo:
            for r in self.references(self.schema.shapes[todo.pop()], set()):
                if r not in self.schema.shapes:
                    raise ShexError("SHEX-REF-001", f"no shape {r}")
                if r not in need:
                    need.add(r)
                    todo.append(r)
        cycle = {name for name in need if name in self.closure(name)}
        if not cycle:
            return self.nodes.join(self.of(self.schema.shapes[label], self.nodes, {}), "node", "left_semi")
        # Only shapes of a cycle are looked at again, each only after one that it refers to has lost a node; the others are made of them.
        every = written(self.everything())
        now, sizes = dict.fromkeys(cycle, every), dict.fromkeys(cycle, every.count())
        means = {name: self.closure(name) & cycle for name in cycle}
        lost = set(cycle)
        while lost:
            again = sorted(name for name in cycle if means[name] & lost)
            made = {name: written(self.of(self.schema.shapes[name], now[name], now)) for name in again}
            counts = {name: made[name].count() for name in again}
            lost = {name for name in again if counts[name] != sizes[name]}
            now, sizes = now | made, sizes | counts
        good = now[label] if label in cycle else self.of(self.schema.shapes[label], self.nodes, now)
        return self.nodes.join(good, "node", "left_semi")

    def closure(self, name: str) -> set[str]:
        seen: set[str] = set()
        todo = [name]
        while todo:
            for r in self.references(self.schema.shapes[todo.pop()], set()):
                if r not in seen and r in self.schema.shapes:
                    seen.add(r)
                    todo.append(r)
        return seen

    def of(self, e: tuple, among: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
        """The nodes among some that satisfy a shape expression."""
        kind = e[0]
        if kind == "and":
            return reduce(lambda df, x: self.of(x, df, known), e[1], among)
        if kind == "or":
            return reduce(DataFrame.union, [self.of(x, among, known) for x in e[1]]).distinct()
        if kind == "not":
            return among.join(self.of(e[1], among, known), "node", "left_anti")
        if kind == "ref":
            if e[1] in known:
                return among.join(known[e[1]], "node", "left_semi")
            return self.of(self.schema.shapes[e[1]], among, known)
        if kind == "shape":
            return self.shape(e[1], among, known)
        return among.where(node_test(e, F.col("node")))

    def shape(self, s: Shape, among: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
        for base in s.extends:
            among = self.of(("ref", base), among, known)
        constraints: list[tuple] = []

        def numbered(e: tuple) -> tuple:
            """The expression with a number for each place of a constraint."""
            if e[0] == "include":
                return numbered(self.schema.labels[e[1]])
            if e[0] == "constraint":
                constraints.append(e)
                return "symbol", len(constraints) - 1, e[4], e[5]
            return e[0], [numbered(x) for x in e[1]], e[2], e[3]

        expression = numbered(s.expression) if s.expression else None
        ways = {(inverse, p) for _, inverse, p, *_ in constraints}
        # One row for each triple of a node that some constraint is about, with a flag for each value test.
        parts = []
        for inverse in (False, True):
            own = [p for i, p in ways if i == inverse]
            if own:
                a, b = ("o", "s") if inverse else ("s", "o")
                parts.append(self.facts.where(F.col("p").isin(own)).select(F.col(a).alias("node"), "p", F.col(b).alias("value"), F.lit(inverse).alias("inverse")).join(among, "node", "left_semi"))
        if not parts:
            out = among
        else:
            triples = reduce(DataFrame.union, parts)
            flags = []
            for i, (_, inverse, p, value, *_) in enumerate(constraints):
                mine = (F.col("p") == p) & (F.col("inverse") == inverse)
                if value is None:
                    test = F.lit(True)
                elif value[0] in ("kind", "datatype", "values", "any"):
                    test = node_test(value, F.col("value"))
                else:
                    fit = self.of(value, triples.where(mine).select(F.col("value").alias("node")).distinct(), known).withColumn(f"x{i}", F.lit(True)).withColumnRenamed("node", f"n{i}")
                    triples = triples.join(fit, F.col("value") == F.col(f"n{i}"), "left").drop(f"n{i}")
                    test = F.coalesce(F.col(f"x{i}"), F.lit(False))
                flags.append((mine & test).alias(f"m{i}"))
            flagged = triples.select("node", "p", "inverse", *flags)
            hit = reduce(lambda a, b: a | b, [F.col(f"m{i}") for i in range(len(constraints))])
            stray = ~hit & ~(F.col("p").isin(s.extra) if s.extra else F.lit(False)) & ~F.col("inverse")
            if len({(inverse, p) for _, inverse, p, *_ in constraints}) == len(constraints):  # no triple fits two
                counts = flagged.groupBy("node").agg(*(F.count(F.when(F.col(f"m{i}"), 1)).alias(f"c{i}") for i in range(len(constraints))), F.count(F.when(stray, 1)).alias("stray"))
                out = among.join(counts, "node", "left").fillna(0).where(F.col("stray") == 0).where(bags.once(expression, lambda i: F.col(f"c{i}"))).select("node")
            else:
                out = chosen(among, flagged, stray, expression, len(constraints))
        if s.closed:
            known_p = [p for i, p in ways if not i] + s.extra
            other = self.facts.where(~F.col("p").isin(known_p) if known_p else F.lit(True)).select(F.col("s").alias("node")).distinct()
            out = out.join(other, "node", "left_anti")
        return out


def chosen(among: DataFrame, flagged: DataFrame, stray: Column, expression: tuple, n: int) -> DataFrame:
    """The nodes whose triples can be told apart into those of each constraint, where a triple may fit several.

    Triples are counted by the set of constraints that they fit (m0, m1, ...). Nodes without a triple that fits several are decided by
    intervals; the others' counts are made distinct, and each combination is decided once.
    """
    fit = F.concat_ws(",", *(F.when(F.col(f"m{i}"), str(i)) for i in range(n)))
    classes = flagged.groupBy("node", fit.alias("fit")).agg(F.count("*").alias("n"), F.count(F.when(stray, 1)).alias("stray"))
    own = F.when(F.col("fit") != "", F.struct("fit", "n"))
    counts = classes.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(own))).alias("own"), F.sum("stray").alias("stray"))
    met = among.join(counts, "node", "left").where(F.coalesce(F.col("stray"), F.lit(0)) == 0)
    several = F.coalesce(F.exists(F.map_keys("own"), lambda x: F.contains(x, F.lit(","))), F.lit(False))
    plain = met.where(~several).where(bags.once(expression, lambda i: F.coalesce(F.element_at("own", str(i)), F.lit(0))))
    vector = F.array_join(F.transform(F.map_entries("own"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";")
    mixed = met.where(several).select("node", vector.alias("vector"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [{frozenset(map(int, k.split(","))): int(v) for k, _, v in (x.partition("=") for x in text.split(";"))} for text in batch.column(0).to_pylist()]
            yield batch.filter(pa.array([bags.fits(expression, x) for x in made], pa.bool_()))

    good = mixed.select("vector").distinct().mapInArrow(decided, "vector string")
    return plain.select("node").union(mixed.join(good, "vector", "left_semi").select("node"))


def validate(facts: DataFrame, nodes: DataFrame, text: str, label: str) -> DataFrame:
    """node, conforms: for each focus node whether it conforms to the shape with that label."""
    v = Validator(parse_shex(text), facts, nodes)
    good = v.conforming(label).withColumn("conforms", F.lit(True))
    return v.nodes.join(good, "node", "left").select("node", F.coalesce("conforms", F.lit(False)).alias("conforms"))
