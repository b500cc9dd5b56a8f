"""Closures against plain searches, and how many rounds they take."""

import random

from quadmill.plans.closure import Closure
from quadmill.plans.datalog import Evaluator


def reached(edges):
    out = set()
    onward: dict = {}
    for a, b in edges:
        onward.setdefault(a, []).append(b)
    for a in onward:
        todo, seen = [a], set()
        while todo:
            for b in onward.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(a, b) for b in seen}
    return out


def test_a_chain_and_a_ring(spark):
    chain = Closure(spark.createDataFrame([(str(i), str(i + 1)) for i in range(1000)], "s string, o string"))
    assert chain.pairs().count() == 1000 * 1001 // 2 and chain.rounds <= 12
    ring = Closure(spark.createDataFrame([(str(i), str((i + 1) % 60)) for i in range(60)], "s string, o string"))
    assert ring.pairs().count() == 3600 and ring.rounds <= 9


def test_random_graphs(spark):
    rng = random.Random(71)
    for n, m in ((30, 33), (40, 120)):
        edges = [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)] + [(str(i), str(i + 1)) for i in range(n, n + 25)]
        frame = spark.createDataFrame([*edges, *edges[:3], (None, "1"), ("1", None)], "s string, o string")
        got = [tuple(r) for r in Closure(frame).pairs().select("s", "o").collect()]
        assert len(got) == len(set(got)) and set(got) == reached(edges)
        some = edges[0][0]
        assert {tuple(r) for r in Closure(frame).onward_from(some).select("s", "o").collect()} == {p for p in reached(edges) if p[0] == some}
    graphs = spark.createDataFrame([("a", "b", "g"), ("b", "c", "h"), ("b", "d", "g")], "s string, o string, g string")
    assert {tuple(r) for r in Closure(graphs, ["g"]).pairs().select("s", "o", "g").collect()} == {("a", "b", "g"), ("b", "c", "h"), ("b", "d", "g"), ("a", "d", "g")}


def test_datalog_forms(spark):
    """The recursions that close a relation, whatever the order of their bodies, and some that only look so."""
    edges, base = [(str(i), str(i + 1)) for i in range(20)], [("x", "3"), ("18", "y"), ("5", "5")]
    tables = {"e": spark.createDataFrame(edges, "c0 string, c1 string"), "b": spark.createDataFrame(base, "c0 string, c1 string")}
    far = reached(edges)
    right = set(base) | {(a, d) for a, b in base for c, d in far if b == c}
    left = set(base) | {(a, d) for a, b in far for c, d in base if b == c}

    def run(text):
        made = Evaluator(spark, tables)
        made.run(text)
        return {tuple(r) for r in made.relation(("p", 2)).collect()}, made.rounds

    for rule in ("p(X, Z) :- p(X, Y), e(Y, Z).", "p(X, Z) :- e(Y, Z), p(X, Y)."):
        got, rounds = run(f"p(X, Y) :- b(X, Y). {rule}")
        assert got == right and 0 < rounds <= 8
    for rule in ("p(X, Z) :- e(X, Y), p(Y, Z).", "p(A, C) :- p(B, C), e(A, B)."):
        assert run(f"p(X, Y) :- b(X, Y). {rule}")[0] == left
    assert run("p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), p(Y, Z).")[0] == far
    assert run("p(X, Y) :- e(X, Y). p(Z, X) :- p(X, Y), e(Y, Z).")[1] == 0
    assert run("p(X, Y) :- e(X, Y). p(X, X) :- p(X, Y), e(Y, X).") == (set(edges), 0)
    assert run('p(X, Y) :- b(X, Y). p(X, Z) :- p(X, "3"), e(Y, Z).')[1] == 0
