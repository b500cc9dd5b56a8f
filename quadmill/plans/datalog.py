"""Datalog with stratified negation as joins, and its programs as facts.

A relation is a table c0, c1, ... of strings for each name and arity; quoted constants keep their quotes.
Strata are evaluated in order, each by a semi-naive fixpoint over written tables; a relation that only
repeats the steps of another takes few rounds (``closure``). Rows with a NULL join with nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import appended, written
from .closure import Closure
from .sparql_parser import quote

TOKEN = re.compile(r"""(?P<skip>(?:\s+|%[^\n]*|\#[^\n]*|//[^\n]*)+)|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>:-|[(),.!])""")
SPACE = "urn:x-datalog-syntax:"


class DatalogError(ValueError):
    def __init__(self, code: str, message: str, at: int = 0):
        super().__init__(f"{code}: {message} at {at}")
        self.code, self.at = code, at


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple[tuple[str, str], ...]  # ("var", name) or ("const", text)

    @property
    def key(self) -> tuple[str, int]:
        return self.name, len(self.args)

    def variables(self) -> set[str]:
        return {v for k, v in self.args if k == "var"}


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[tuple[bool, Atom], ...]  # (positive, atom); empty for a fact


def parse_datalog(text: str) -> list[Rule]:
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise DatalogError("DATALOG-SYNTAX-001", f"unexpected {text[at]!r}", at)
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0], at))
        at = m.end()
    tokens.append(("end", "", at))
    i = 0

    def op(s: str) -> bool:
        nonlocal i
        if tokens[i][:2] == ("op", s):
            i += 1
            return True
        return False

    def need(s: str) -> None:
        if not op(s):
            raise DatalogError("DATALOG-SYNTAX-001", f"expected {s!r}, found {tokens[i][1]!r}", tokens[i][2])

    def atom() -> Atom:
        nonlocal i
        kind, name, where = tokens[i]
        if kind != "name":
            raise DatalogError("DATALOG-SYNTAX-001", f"expected a relation, found {name!r}", where)
        i += 1
        need("(")
        args: list[tuple[str, str]] = []
        while not op(")"):
            if args:
                need(",")
            kind, value, where = tokens[i]
            if kind not in ("name", "str", "num"):
                raise DatalogError("DATALOG-SYNTAX-001", f"expected an argument, found {value!r}", where)
            i += 1
            args.append(("var" if kind == "name" and (value[0].isupper() or value[0] == "_") else "const", value))
        return Atom(name, tuple(args))

    rules = []
    while tokens[i][0] != "end":
        head = atom()
        body = []
        if op(":-"):
            while True:
                negated = op("!") or (tokens[i][:2] == ("name", "not") and tokens[i + 1][0] == "name")
                if negated and tokens[i][1] == "not":
                    i += 1
                body.append((not negated, atom()))
                if not op(","):
                    break
        need(".")
        rules.append(Rule(head, tuple(body)))
    return rules


def encode_datalog(text: str) -> list[tuple[str, str, str, None]]:
    """The program's tree as facts: program, rule, head, body, atom and arg, and negated."""
    out: list[tuple[str, str, str, None]] = []
    n = 0

    def fresh() -> str:
        nonlocal n
        n += 1
        return f"_:.{n}"

    def say(s: str, p: str, o: str) -> None:
        out.append((s, f"<{SPACE}{p}>", o, None))

    def atom(node: str, a: Atom) -> None:
        say(node, "atom", quote(a.name))
        for kind, value in a.args:
            arg = fresh()
            say(node, "arg", arg)
            say(arg, "arg", quote(("?" if kind == "var" else "") + value))

    for r in parse_datalog(text):
        node = fresh()
        say(f"<{SPACE}program>", "rule" if r.body else "fact", node)
        if not r.body:
            atom(node, r.head)
            continue
        head = fresh()
        say(node, "head", head)
        atom(head, r.head)
        for positive, a in r.body:
            literal, inner = fresh(), fresh()
            say(node, "body", literal)
            if not positive:
                say(literal, "negated", '"true"')
            say(literal, "atom", inner)
            atom(inner, a)
    return out


def stratify(rules: list[Rule]) -> list[list[Rule]]:
    """Rules by stratum: what a negation needs is complete before it."""
    level = {k: 0 for r in rules for k in [r.head.key, *(a.key for _, a in r.body)]}
    for _ in range(len(level) + 1):
        before = dict(level)
        for r in rules:
            for positive, a in r.body:
                level[r.head.key] = max(level[r.head.key], level[a.key] + (not positive))
        if level == before:
            return [own for n in range(max(level.values(), default=0) + 1) if (own := [r for r in rules if level[r.head.key] == n])]
    raise DatalogError("DATALOG-STRATA-001", "negation inside recursion")


def check_safe(rules: list[Rule]) -> None:
    for r in rules:
        bound = set().union(*(a.variables() for positive, a in r.body if positive), set())
        used = r.head.variables() | set().union(*(a.variables() for positive, a in r.body if not positive), set())
        if free := {v for v in used if v != "_"} - bound or ({"_"} & r.head.variables()):
            raise DatalogError("DATALOG-SAFE-001", f"{min(free)} is not bound in the rule of {r.head.name}")


def closed(own: list[Rule], key: tuple[str, int]) -> tuple[tuple[str, int], str] | None:
    """The relation whose steps a rule of two atoms repeats, and on which side of the own relation it stands, where nothing else recurs.

    p(X, Z) :- p(X, Y), e(Y, Z) or p(X, Z) :- e(X, Y), p(Y, Z) or p(X, Z) :- p(X, Y), p(Y, Z), for which the side is both.
    """
    heads = {r.head.key for r in own}
    again = [r for r in own if any(positive and a.key in heads for positive, a in r.body)]
    if len(heads) > 1 or len(again) != 1 or key[1] != 2:
        return None
    (rule,) = again
    if len(rule.body) != 2 or not all(positive for positive, _ in rule.body):
        return None
    (_, a), (_, b) = rule.body
    if [x[0] for atom in (rule.head, a, b) for x in atom.args] != ["var"] * 6:
        return None
    if set(a.args) & set(rule.head.args[1:]):  # the body's other order
        a, b = b, a
    x, y, z = a.args[0], a.args[1], b.args[1]
    if len({x, y, z}) != 3 or ("var", "_") in (x, y, z) or b.args[0] != y or list(rule.head.args) != [x, z]:
        return None
    if a.key == b.key == key:
        return key, "both"
    return (b.key, "right") if a.key == key else (a.key, "left") if b.key == key else None


class Evaluator:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.rounds = spark, 0
        self.relations: dict[tuple[str, int], DataFrame] = {}
        for name, df in (tables or {}).items():
            self.relations[name, len(df.columns)] = df.toDF(*(f"c{i}" for i in range(len(df.columns)))) if df.columns else df

    def empty(self, arity: int) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(arity)) or "u int")

    def columns(self, arity: int) -> list[str]:
        return [f"c{i}" for i in range(arity)] or ["u"]

    def relation(self, key: tuple[str, int]) -> DataFrame:
        return self.relations.get(key, self.empty(key[1]))

    def bound(self, a: Atom, df: DataFrame) -> DataFrame:
        """The atom's solutions, a column for each variable."""
        seen: dict[str, str] = {}
        for i, (kind, value) in enumerate(a.args):
            if kind == "const":
                df = df.where(F.col(f"c{i}") == value)
            elif value == "_":
                continue
            elif value in seen:
                df = df.where(F.col(f"c{i}") == F.col(seen[value]))
            else:
                seen[value] = f"c{i}"
        return df.select(*(F.col(c).alias("v_" + "".join("~" + x.lower() if x.isupper() else x for x in v)) for v, c in seen.items())) if seen else df.select(F.lit(1).alias("u")).limit(1).select()

    def rule(self, r: Rule, delta: tuple[int, DataFrame] | None = None) -> DataFrame:
        """What a rule derives; delta: a table in place of that of one body literal."""
        if not r.body:
            if r.head.variables():
                raise DatalogError("DATALOG-SAFE-001", f"a variable in the fact {r.head.name}")
            return self.spark.createDataFrame([tuple(v for _, v in r.head.args) or (1,)], ", ".join(f"{c} {'string' if r.head.args else 'int'}" for c in self.columns(len(r.head.args))))
        name = lambda v: "v_" + "".join("~" + x.lower() if x.isupper() else x for x in v)
        left = [self.bound(a, delta[1] if delta and delta[0] == i else self.relation(a.key)) for i, (positive, a) in enumerate(r.body) if positive]
        if delta:  # what is new goes first
            left.insert(0, left.pop(sum(positive for positive, _ in r.body[: delta[0]])))
        now = left.pop(0) if left else None
        while left:
            # Whatever order the body has: the next one is joined to what is there, where one can be.
            i = next((i for i, df in enumerate(left) if set(df.columns) & set(now.columns)), 0)
            df = left.pop(i)
            shared = [c for c in now.columns if c in df.columns]
            now = now.join(df, shared) if shared else now.crossJoin(df)
        if now is None:
            now = self.spark.range(1).select()
        for positive, a in r.body:
            if not positive:
                df = self.bound(a, self.relation(a.key))
                now = now.join(df.distinct(), df.columns, "left_anti") if df.columns else (now if df.isEmpty() else now.limit(0))
        head = [F.col(f"`{name(v)}`").alias(f"c{i}") if kind == "var" else F.lit(v).alias(f"c{i}") for i, (kind, v) in enumerate(r.head.args)]
        return now.select(*head).distinct() if head else now.select(F.lit(1).alias("u")).limit(1)

    def close(self, key: tuple[str, int], step: tuple[str, int], side: str) -> None:
        """The relation with any number of steps on one side, by doubling."""
        named = lambda df, s, o: df.select(F.col("c0").alias(s), F.col("c1").alias(o))
        closure = Closure(named(self.relation(step), "s", "o"))
        far = closure.pairs()
        self.rounds += closure.rounds
        if side == "both":
            self.relations[key] = written(self.relations[key].union(far.select("s", "o")).distinct())
            return
        near, steps = (named(self.relations[key], "s", "m"), far.withColumnRenamed("s", "m")) if side == "right" else (far.withColumnRenamed("o", "m"), named(self.relations[key], "m", "o"))
        more = near.join(steps, "m").select(F.col("s").alias("c0"), F.col("o").alias("c1"))
        self.relations[key] = written(self.relations[key].union(more).distinct())

    def run(self, text: str) -> None:
        rules = parse_datalog(text)
        check_safe(rules)
        for own in stratify(rules):
            heads = {r.head.key for r in own}
            recursive = [r for r in own if any(p and a.key in heads for p, a in r.body)]
            delta = {}
            for key in heads:
                first = [self.rule(r) for r in own if r.head.key == key and r not in recursive]
                base = [self.relations[key]] if key in self.relations else []
                self.relations[key] = written(reduce(DataFrame.union, [*base, *first], self.empty(key[1])).distinct()) if recursive or len(first) + len(base) != 1 else first[0] if first else base[0]
                delta[key] = self.relations[key]
            if len(heads) == 1 and recursive and (step := closed(own, key)):
                self.close(key, *step)
                continue
            while recursive:
                new: dict[tuple[str, int], list[DataFrame]] = {}
                for r in recursive:
                    for i, (positive, a) in enumerate(r.body):
                        if positive and a.key in delta:
                            new.setdefault(r.head.key, []).append(self.rule(r, (i, delta[a.key])))
                delta = {}
                for key, made in new.items():
                    more = written(reduce(DataFrame.union, made).distinct().join(self.relations[key], self.columns(key[1]), "left_anti"))
                    if not more.isEmpty():
                        delta[key] = more
                for key, more in delta.items():
                    self.relations[key] = appended([self.relations[key], more])
                if not delta:
                    break


def datalog(spark: SparkSession, text: str, tables: dict[str, DataFrame], goal: str, arity: int) -> DataFrame:
    """The relation ``goal`` after the program has run over tables of strings."""
    e = Evaluator(spark, tables)
    e.run(text)
    return e.relation((goal, arity))
