"""Facts by characteristic sets answer as plain facts do, without joining a subject with itself."""

import random

from quadmill.plans import stars
from quadmill.plans.mapping import Facts
from quadmill.plans.sparql import sparql
from quadmill.plans.stars import Stars

STAR = "SELECT * WHERE { ?s <urn:p0> ?a ; <urn:p1> ?b ; <urn:p2> ?c ; <urn:p3> ?d ; <urn:p4> ?e }"


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_a_star_of_five_has_no_join(spark):
    facts = [(f"<s:{i}>", f"<urn:p{j}>", f'"{i % 7}.{k}"', None) for i in range(40) for j in range(5 + i % 3) for k in range(1 + (i + j) % 3)]
    df = spark.createDataFrame(facts, "s string, p string, o string, g string")
    found = sparql(spark, Stars.of(df.union(df)), STAR)
    assert rows(found) == rows(sparql(spark, Facts(df), STAR)) and found.count() > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("LeftAnti", "") and "Exchange" not in plan


def test_layouts_agree(spark, tmp_path, monkeypatch):
    """Few tables, few values, hot subjects, several graphs: all that isn't in a wide table is in the rest."""
    rng = random.Random(81)
    facts = [(f"<s:{rng.randrange(30)}>", f"<urn:p{rng.choice([0, 0, 0, 1, 1, 2, 3])}>", f'"{rng.randrange(6)}"', rng.choice([None, None, "<g:1>", "<g:2>"])) for _ in range(300)]
    facts += [("<s:hot>", "<urn:p0>", f'"{i}"', None) for i in range(50)] + [("<s:hot>", "<urn:p1>", '"x"', None)]
    df = spark.createDataFrame(facts, "s string, p string, o string, g string")
    plain = Facts(df.distinct())
    texts = [
        "SELECT * WHERE { ?s <urn:p0> ?a ; <urn:p1> ?b }", "SELECT * WHERE { ?s <urn:p0> ?a ; <urn:p1> ?b ; <urn:p2> '3' }", "SELECT * WHERE { GRAPH ?g { ?s <urn:p0> ?a ; <urn:p1> ?b } }", "SELECT * WHERE { GRAPH <g:1> { ?s <urn:p1> ?b ; <urn:p0> ?b } }",
        "SELECT * WHERE { ?s <urn:p9> ?a ; <urn:p1> ?b }", "SELECT * WHERE { ?s <urn:p0> ?a . ?t <urn:p1> ?a }", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", "SELECT * WHERE { ?s <urn:p3> ?a OPTIONAL { ?s <urn:p2> ?b } }",
    ]
    want = [rows(sparql(spark, plain, t)) for t in texts]
    for sets, values in ((64, 1000), (3, 2), (0, 5)):
        made = Stars.of(df, sets, values)
        assert [rows(sparql(spark, made, t)) for t in texts] == want
    monkeypatch.setattr(stars, "PREDICATES", 2)
    made = Stars.of(df, 5)
    made.save(f"{tmp_path}/stars")
    again = Stars.load(spark, f"{tmp_path}/stars")
    for text, told in zip(texts[:3], want, strict=False):
        assert rows(sparql(spark, made, text)) == rows(sparql(spark, again, text)) == told


def test_facts_are_dealt_by_subject_once(spark, monkeypatch):
    """Strings are shuffled to gather a subject's facts, and for nothing else where no subject is large."""
    seen, keep = [], stars.written
    monkeypatch.setattr(stars, "written", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    facts = [(f"<s:{i}>", f"<urn:p{j}>", f'"{i % 7}.{k}"', None) for i in range(40) for j in range(3 + i % 2) for k in range(1 + j % 2)]
    Stars.of(spark.createDataFrame(facts, "s string, p string, o string, g string"))
    gathered = [p for p in seen if "collect_set" in p]
    tables = seen[seen.index(gathered[0]) + 1 :]
    assert len(gathered) == 1 and len(tables) == 3
    assert not any("hashpartitioning" in p and "LeftAnti" not in p for p in tables[:2])
