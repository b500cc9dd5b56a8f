"""The order of numeric terms against exact fractions, and solutions that are told apart."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from quadmill.functions import terms as T
from quadmill.plans import sparql as S
from quadmill.plans.mapping import Facts

XSD = "http://www.w3.org/2001/XMLSchema#"


def test_number_key(spark):
    rng = random.Random(61)
    texts = ["0", "-0", "+0", "0.0", "-0.00", "00", "1", "+1", "-1", "01", "1.", ".5", "-.5", "10", "100", "9007199254740992", "9007199254740993", "-9007199254740993", "-9007199254740992", "9" * 60, "9" * 59 + "8", "-" + "9" * 60, "-" + "9" * 59 + "8", "0." + "0" * 50 + "1", "-0." + "0" * 50 + "1", "1" + "0" * 45, "1." + "0" * 45 + "1"]
    for _ in range(400):
        whole, part = "".join(rng.choices("0019", k=rng.randrange(0, 45))), "".join(rng.choices("0019", k=rng.randrange(0, 45)))
        if whole or part:
            texts.append(rng.choice(["", "-", "+"]) + whole + ("." + part if part or rng.random() < 0.2 else ""))
    terms = [(f'"{x}"^^<{XSD}{"decimal" if "." in x else "integer"}>', Fraction(x.rstrip(".") if "." in x else x)) for x in texts]
    for x in ["1e0", "1.5E3", "-2e-7", "1E300", "-1e300", "0.1", "4.9E-324", "-0e5", "12345678.9"]:
        terms.append((f'"{x}"^^<{XSD}double>', Fraction(x)))
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t, _ in terms], "t string").select("t", T.number_key(F.col("t")).alias("k")).collect()}
    own = sorted(set(terms), key=lambda x: x[1])
    for (a, x), (b, y) in zip(own, own[1:], strict=False):
        assert (got[a] < got[b]) == (x < y) and (got[a] == got[b]) == (x == y), (a, b)
    odd = [f'"{x}"^^<{XSD}double>' for x in ("-INF", "-1e308", "1e308", "INF", "NaN")]
    keys = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").orderBy("i").select(T.number_key(F.col("t")).alias("k")).collect()]
    assert keys == sorted(keys) and len(set(keys)) == 5
    none = ['"x"', '"1"', f'"x"^^<{XSD}integer>', "<urn:1>", "_:b1", f'"1"^^<{XSD}date>', '"1"@en']
    assert [r.k for r in spark.createDataFrame([(t,) for t in none], "t string").select(T.number_key(F.col("t")).alias("k")).collect()] == [None] * len(none)


def test_equal_solutions_are_told_apart(spark, monkeypatch):
    """Whatever the blocks that they are dealt in; a second reading gives the same labels."""
    df = spark.createDataFrame([("<a>", None)] * 50 + [("<b>", '"x"')] * 7 + [(None, None)] * 3, "v_x string, v_y string").repartition(6)
    for most in (1 << 16, 4, 1):
        monkeypatch.setattr(S, "ALIKE", most)
        made = S.numbered(S.Solutions(df, {"x": False, "y": False}))
        row = S.row_of(made)
        rows = made.df.collect()
        assert len(rows) == 60 == len({r[S.column_name(row)] for r in rows})
        assert sum(r.v_x == "<a>" for r in rows) == 50 and sum(r.v_x is None for r in rows) == 3
        assert sorted(map(str, made.df.collect())) == sorted(map(str, rows))
    empty = S.numbered(S.Solutions(df.where("false"), {"x": False, "y": False}))
    assert empty.df.count() == 0 and S.numbered(S.unit(spark)).df.count() == 1


def test_blank_nodes_of_solutions(spark):
    facts = Facts(spark.createDataFrame([(f"<urn:{i}>", "<urn:p>", f'"{i % 2}"', None) for i in range(6)], "s string, p string, o string, g string"))
    run = lambda text: S.sparql(spark, facts, text).collect()
    assert len(run("CONSTRUCT { [] <urn:q> ?o } WHERE { SELECT ?o { ?s <urn:p> ?o } }")) == 6
    assert len({r.s for r in run("CONSTRUCT { [] <urn:q> 1 ; <urn:r> 2 } WHERE { SELECT ?z { ?s <urn:p> ?o } }")}) == 6
    same = run("SELECT (BNODE('k') AS ?a) (BNODE('k') AS ?b) (BNODE('l') AS ?c) ?s WHERE { ?s <urn:p> ?o }")
    assert all(r.a == r.b != r.c for r in same) and len({r.a for r in same} | {r.c for r in same}) == 12
    joined = run("SELECT ?a ?b ?o WHERE { { SELECT ?o { ?s <urn:p> ?o } } BIND(BNODE('k') AS ?a) ?t <urn:p> ?o BIND(BNODE('k') AS ?b) }")
    assert len(joined) == 18 and all(r.a == r.b for r in joined) and len({r.a for r in joined}) == 6
    assert len(run("SELECT ?s WHERE { ?s <urn:p> ?o FILTER(SAMETERM(BNODE('x'), BNODE('x')) && !SAMETERM(BNODE('x'), BNODE('y'))) }")) == 6
    grouped = run("SELECT ?o (BNODE(STR(?o)) AS ?n) (COUNT(DISTINCT *) AS ?c) WHERE { ?s <urn:p> ?o ; <urn:p> _:z } GROUP BY ?o")
    assert len({r.n for r in grouped}) == 2 and {r.c for r in grouped} == {f'"3"^^<{XSD}integer>'}
    assert len(run("SELECT (COUNT(DISTINCT BNODE('k')) AS ?c) WHERE { ?s <urn:p> ?o }")[0].c.split('"6"')) == 2
