"""Regular bag expressions against all their bags, and triple constraints that share a predicate against all assignments."""

import itertools
import random

from pyspark.sql import functions as F

from quadmill.plans import bags
from quadmill.plans.shex import parse_shex, validate

SYMBOLS, MOST = 4, 5


def language(e, n):
    """All bags of an expression with at most n things, as vectors of counts."""
    kind, parts, low, high = e
    zero = (0,) * SYMBOLS
    plus = lambda a, b: {c for x in a for y in b if sum(c := tuple(map(sum, zip(x, y, strict=True)))) <= n}
    if kind == "symbol":
        once = {tuple(int(i == parts) for i in range(SYMBOLS))}
    elif kind == "each":
        once = {zero}
        for x in parts:
            once = plus(once, language(x, n))
    else:
        once = set().union(*(language(x, n) for x in parts))
    out, power = set(), {zero}
    for j in range(min(high, low + n + 1) + 1):
        if j >= low:
            out |= power
        power = plus(power, once)
    return out


def expression(rng, symbols, depth=0):
    low, high = rng.choice([(1, 1)] * 4 + [(0, 1), (0, bags.MANY), (1, bags.MANY), (2, 2), (2, 3), (0, 0), (1, 2), (0, 2), (3, bags.MANY)])
    if len(symbols) == 1:
        e = ("symbol", symbols[0], low, high)
        return e if rng.random() < 0.8 else (rng.choice(["each", "one"]), [("symbol", symbols[0], *rng.choice([(1, 1), (0, 2)]))], low, high)
    at = rng.randrange(1, len(symbols))
    return rng.choice(["each", "each", "one"]), [expression(rng, symbols[:at], depth + 1), expression(rng, symbols[at:], depth + 1)], low, high


def test_fits_against_all_assignments():
    rng = random.Random(51)
    every = [frozenset(c) for k in range(1, SYMBOLS + 1) for c in itertools.combinations(range(SYMBOLS), k)]
    told = [0, 0]
    for _ in range(1500):
        e = expression(rng, list(range(SYMBOLS)))
        words = language(e, MOST)
        for _ in range(4):
            things = [rng.choice(every) for _ in range(rng.randrange(MOST + 1))]
            classes: dict = {}
            for c in things:
                classes[c] = classes.get(c, 0) + 1
            want = any(tuple(choice.count(i) for i in range(SYMBOLS)) in words for choice in itertools.product(*things))
            assert bags.fits(e, classes) == want, (e, classes)
            told[want] += 1
    assert min(told) > 500


def test_many_things():
    """Counts in the millions are decided by their intervals, not one by one."""
    e = ("each", [("each", [("symbol", 0, 1, 1), ("symbol", 1, 2, 3)], 0, bags.MANY), ("symbol", 2, 0, bags.MANY)], 1, 1)
    assert bags.fits(e, {frozenset([0]): 10**6, frozenset([1, 2]): 3 * 10**6})
    assert bags.fits(e, {frozenset([0]): 10**6, frozenset([1]): 2 * 10**6 - 1, frozenset([1, 2]): 1})
    assert not bags.fits(e, {frozenset([0]): 10**6, frozenset([1]): 2 * 10**6 - 1})
    assert not bags.fits(e, {frozenset([0, 1]): 2 * 10**6 + 1, frozenset([2]): 5, frozenset([1]): 10**7})


def test_intervals_against_all_bags(spark):
    rng = random.Random(52)
    vectors = [v for v in itertools.product(range(MOST + 1), repeat=SYMBOLS) if sum(v) <= MOST]
    table = spark.createDataFrame(vectors, [f"c{i}" for i in range(SYMBOLS)])
    own = [expression(rng, list(range(SYMBOLS))) for _ in range(12)]
    told = table.select(*(f"c{i}" for i in range(SYMBOLS)), *(bags.once(e, lambda i: F.col(f"c{i}")).alias(f"e{k}") for k, e in enumerate(own))).collect()
    for k, e in enumerate(own):
        assert {tuple(r)[:SYMBOLS] for r in told if r[f"e{k}"]} == language(e, MOST), e


def conforming(spark, facts, text):
    frame = spark.createDataFrame(facts, "s string, p string, o string")
    return {r.node for r in validate(frame, frame.select(F.col("s").alias("node")), text, "<urn:S>").collect() if r.conforms}


def test_triples_that_fit_several(spark):
    one, two, three = (f'"{i}"^^<http://www.w3.org/2001/XMLSchema#integer>' for i in (1, 2, 3))
    p, a, b = "<urn:p>", "<urn:a>", "<urn:b>"
    nodes = {"<n:12>": [(p, one), (p, two)], "<n:1>": [(p, one)], "<n:2>": [(p, two)], "<n:23>": [(p, two), (p, three)], "<n:123>": [(p, one), (p, two), (p, three)], "<n:a2b2>": [(a, one), (a, two), (b, one), (b, two)], "<n:a2>": [(a, one), (a, two)], "<n:a2b3>": [(a, one), (a, two), (b, one), (b, two), (b, three)], "<n:a1>": [(a, one)]}
    facts = [(n, q, o) for n, own in nodes.items() for q, o in own]
    said = lambda body: conforming(spark, facts, f"PREFIX : <urn:> :S {body}")
    assert said("{ :p . ; :p [1] }") == {"<n:12>"}
    assert said("{ :p . + ; :p [1] }") == {"<n:12>", "<n:123>"}
    assert said("EXTRA :p { :p [1] ; :p [1 2] }") == {"<n:12>", "<n:123>"}
    assert said("EXTRA :p { :p [2] ; :p [1 2] ? }") == {"<n:12>", "<n:2>", "<n:23>", "<n:123>"}
    assert said("{ ( :a . ; :b . ? ){2} }") == {"<n:a2b2>", "<n:a2>"}
    assert said("{ ( :a . | :p [1] ; :p . ){2} }") == {"<n:a2b2>", "<n:a2>", "<n:a2b3>"}
    assert said("{ $:x ( :p . | :a [1] ) ; &:x }") == {"<n:12>", "<n:23>"}
