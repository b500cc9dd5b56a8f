"""Operators on small tables, against what they must give."""

import random

import pytest

from quadmill.operators import facts as O
from quadmill.plans.datalog import DatalogError, datalog
from quadmill.plans.mapping import Facts
from quadmill.plans.sparql import sparql
from quadmill.plans.update import update
from quadmill.sources import reader, sinks
from quadmill.sources.rdf_text import parse_text

SCHEMA = "doc_id string, s string, p string, o string, g string, src_offset long, parser string"


def store(spark, text, format="trig"):
    rows, _ = parse_text("@prefix : <http://e/> . @prefix x: <http://www.w3.org/2001/XMLSchema#> . " + text, format)
    return spark.createDataFrame([("d", *q, i, "t") for i, q in enumerate(rows)], SCHEMA)


def ask(spark, data, text):
    df = sparql(spark, Facts(store(spark, data)), "PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + text)
    short = lambda t: t if t is None or isinstance(t, bool) else t.replace("http://e/", "").replace("^^<http://www.w3.org/2001/XMLSchema#", "^")
    return sorted((tuple(map(short, r)) for r in df.collect()), key=str)


def test_unbound_joins(spark):
    got = ask(spark, ":a :p 1 ; :q 5 . :b :p 2 . :c :q 2 .", "SELECT ?s ?v ?t { ?s :p ?n OPTIONAL { ?s :q ?v } ?t :q ?v }")
    assert got == [("<a>", '"5"^integer>', "<a>"), ("<b>", '"2"^integer>', "<c>"), ("<b>", '"5"^integer>', "<a>")]


def test_errors_in_filters_and_aggregates(spark):
    data = ":a :v 1 . :a :v 2 . :b :v 3 . :b :v 'x' ."
    assert ask(spark, data, "SELECT ?s (SUM(?v) AS ?t) { ?s :v ?v } GROUP BY ?s") == [("<a>", '"3"^integer>'), ("<b>", None)]
    assert ask(spark, data, "SELECT ?v { ?s :v ?v FILTER(?v + 1 > 2 || ?v = 'x') }") == [('"2"^integer>',), ('"3"^integer>',), ('"x"',)]
    assert ask(spark, data, "SELECT (COALESCE(?v / 0, 'none') AS ?c) { :a :v ?v }") == [('"none"',)] * 2


def test_value_and_term_equality(spark):
    data = ":a :v 1 . :b :v 01 . :c :v 1.0 ."
    assert len(ask(spark, data, "SELECT DISTINCT ?v { ?s :v ?v }")) == 3
    assert len(ask(spark, data, "SELECT ?s { ?s :v ?v FILTER(?v = 1) }")) == 3
    assert len(ask(spark, data, "SELECT ?s { ?s :v ?v FILTER(SAMETERM(?v, 1)) }")) == 1


def test_paths_on_a_cycle(spark):
    data = ":a :p :b . :b :p :c . :c :p :a . :c :q :d ."
    assert len(ask(spark, data, "SELECT ?x ?y { ?x :p+ ?y }")) == 9
    assert ask(spark, data, "SELECT ?y { :a (:p|:q)* ?y }") == [("<a>",), ("<b>",), ("<c>",), ("<d>",)]
    assert ask(spark, data, "SELECT ?y { :z :p* ?y }") == [("<z>",)]
    assert ask(spark, data, "SELECT ?x { ?x :p+ :a }") == [("<a>",), ("<b>",), ("<c>",)]
    assert ask(spark, data, "SELECT ?x { ?x !:p ?y }") == [("<c>",)]
    assert ask(spark, data, "SELECT ?x { ?x !^:p ?y }") == [("<d>",)]


def test_graphs(spark):
    data = "{ :a :p 1 } :g { :a :p 2 } :h { :a :p 3 }"
    assert ask(spark, data, "SELECT ?v { :a :p ?v }") == [('"1"^integer>',)]
    assert ask(spark, data, "SELECT ?g ?v { GRAPH ?g { :a :p ?v } }") == [("<g>", '"2"^integer>'), ("<h>", '"3"^integer>')]
    assert ask(spark, data, "SELECT ?v FROM :g FROM NAMED :h { { :a :p ?v } UNION { GRAPH ?g { :a :p ?v } } }") == [('"2"^integer>',), ('"3"^integer>',)]


def test_minus_and_not_exists_differ(spark):
    data = ":a :p 1 . :b :p 2 ."
    assert len(ask(spark, data, "SELECT * { ?s :p ?n MINUS { ?x :p ?y } }")) == 2
    assert ask(spark, data, "SELECT * { ?s :p ?n FILTER NOT EXISTS { ?x :p ?y } }") == []


def test_letter_case_of_variables(spark):
    assert ask(spark, ":a :p 1 .", "SELECT ?x ?X { ?x :p ?X }") == [("<a>", '"1"^integer>')]


def test_order_and_strings(spark):
    got = sparql(spark, Facts(store(spark, ":a :v 10 . :b :v 9 . :c :v 'x' . :d :v :i . :e :v _:b .")), "SELECT ?v { ?s <http://e/v> ?v } ORDER BY ?v").collect()
    assert [r[0][:3] for r in got][1:] == ["<ht", '"x"', '"9"', '"10'] or [r[0][0] for r in got] == ["_", "<", '"', '"', '"']
    assert ask(spark, ":a :v 'motor'@en .", "SELECT (SUBSTR(?v, 2) AS ?a) (STRBEFORE(?v, 't') AS ?b) (STRAFTER(?v, 'z') AS ?c) (CONCAT(?v, ?v) AS ?d) { ?s :v ?v }") == [('"otor"@en', '"mo"@en', '""', '"motormotor"@en')]


def test_updates_with_blank_nodes(spark):
    facts = store(spark, ":a :p 1 . :b :p 2 .").select("s", "p", "o", "g")
    out = update(spark, facts, "PREFIX : <http://e/> DELETE { ?s :p ?v } INSERT { ?s :q [ :v ?v ] } WHERE { ?s :p ?v } ; DELETE DATA { :a :p 1 }")
    rows = out.collect()
    assert len(rows) == 4 and len({r.s for r in rows if r.s.startswith("_:")}) == 2
    with pytest.raises(ValueError):
        update(spark, facts, "CLEAR GRAPH <g:none>")


def test_canonicalise_is_stable(spark):
    rng = random.Random(3)
    for _ in range(3):
        lines = [f"_:x{rng.randrange(4)} :p{rng.randrange(3)} {rng.choice([':a', '1', chr(95) + ':x' + str(rng.randrange(4))])} ." for _ in range(8)]
        facts = store(spark, " ".join(lines))
        once = O.canonicalise(facts)
        twice = O.canonicalise(once)
        assert sorted(map(str, once.select("s", "p", "o", "g").collect())) == sorted(map(str, twice.select("s", "p", "o", "g").collect()))
        assert O.diff(once, twice).isEmpty()


def test_diff_commutes_and_round_trips(spark):
    a, b = store(spark, ":a :p 1, 2 . :b :q 'x\\n\"y\"' ."), store(spark, ":a :p 2, 3 .")
    left, right = O.diff(a, b).collect(), O.diff(b, a).collect()
    assert sorted((r.kind, r.s, r.o) for r in left) == sorted((r.kind, r.s, r.o) for r in right)
    text = sinks.turtle(a, {"": "http://e/"}).first().text
    back, _ = parse_text(text, "ttl")
    assert O.same_facts(a, spark.createDataFrame([("d", *q, i, "t") for i, q in enumerate(back)], SCHEMA))


def test_check_canonical(spark):
    O.check_canonical(store(spark, ":a :p 'x' ."))
    with pytest.raises(ValueError):
        O.check_canonical(spark.createDataFrame([("d", "<a:a>", "_:p", '"x"', None, 0, "t")], SCHEMA))


def test_read_lines(spark, tmp_path):
    (tmp_path / "f.nq").write_text('<a:a> <b:b> "x y" .\n<a:a>  <b:b> "q\\"z"@EN <g:g> . <c:c> <b:b> <d:d> .\n# no\n<a:a> <b:b> "s p"@en-us <g:h> .\nbad\n')
    rows = reader.read_lines(spark, str(tmp_path / "f.nq"), "nq").collect()
    assert sorted((r.o, r.g) for r in rows if r.error is None) == sorted([('"x y"', None), ('"q\\"z"@en', "<g:g>"), ("<d:d>", None), ('"s p"@en-US', "<g:h>")])
    assert sum(r.error is not None for r in rows) == 1


def test_unsafe_datalog(spark):
    for bad in ("p(X) :- q(Y).", "p(X).", "p(X) :- not q(X)."):
        with pytest.raises(DatalogError):
            datalog(spark, bad, {}, "p", 1).count()


def test_failed_aggregates(spark):
    data = ":a :v 1 . :a :v 2 . :b :v 3 . :b :v 'x' . :c :v 1.5 . :c :v 2 ."
    by = "{ ?s :v ?v } GROUP BY ?s"
    assert ask(spark, data, f"SELECT ?s (SUM(DISTINCT ?v) AS ?t) (AVG(?v) AS ?m) {by}") == [("<a>", '"3"^integer>', '"1.5"^decimal>'), ("<b>", None, None), ("<c>", '"3.5"^decimal>', '"1.75"^decimal>')]
    assert ask(spark, data, f"SELECT ?s {by} HAVING (SUM(?v) > 2)") == [("<a>",), ("<c>",)]
    assert ask(spark, data, f"SELECT ?s {by} HAVING (AVG(?v) > 1 || ?s = :b)") == [("<a>",), ("<b>",), ("<c>",)]


def test_long_integers(spark):
    data = ":a :v 123456789012345678901234567890 . :b :v 100000000000000000000000000000 . :b :v 1 ."
    assert ask(spark, data, "SELECT (?v + 1 AS ?t) { :a :v ?v }") == [('"123456789012345678901234567891"^integer>',)]
    assert ask(spark, data, "SELECT ?s (SUM(?v) AS ?t) { ?s :v ?v } GROUP BY ?s") == [("<a>", '"123456789012345678901234567890"^integer>'), ("<b>", '"100000000000000000000000000001"^integer>')]
    assert ask(spark, data, "SELECT ?v { ?s :v ?v FILTER(?v * 2 > 250000000000000000000000000000) }") == []
    assert ask(spark, data, "SELECT (99999999999999999999999 * 10 AS ?t) {}") == [('"999999999999999999999990"^integer>',)]


def test_exists_in_expressions(spark):
    data = ":a :v 1 ; :v 2 ; :v 3 . :x :w 2 . :y :w 3 ."
    assert ask(spark, data, "SELECT ?v { ?s :v ?v FILTER(?v = 1 || EXISTS { ?x :w ?w FILTER(?w = ?v) }) }") == [('"1"^integer>',), ('"2"^integer>',), ('"3"^integer>',)]
    assert ask(spark, data, "SELECT ?v { ?s :v ?v FILTER(?v = 1 || NOT EXISTS { ?x :w ?w FILTER(?w = ?v) }) }") == [('"1"^integer>',)]
    assert ask(spark, data, "SELECT ?v { ?s :v ?v BIND(EXISTS { ?x :w ?v } AS ?e) FILTER(?e) }") == [('"2"^integer>',), ('"3"^integer>',)]
    # Equal solutions stay as many as they are, bound or not.
    twice = "{ VALUES ?u { 1 1 UNDEF UNDEF } FILTER(?u = 7 || EXISTS { ?x :w ?w }) }"
    assert len(ask(spark, data, f"SELECT ?u {twice}")) == 4
    assert len(ask(spark, data, "SELECT ?v { VALUES ?v { 2 2 UNDEF UNDEF 9 } FILTER(COALESCE(?v, 0) = 9 || EXISTS { ?x :w ?v }) }")) == 5
    assert ask(spark, data, "SELECT ?v { ?s :v ?v FILTER EXISTS { ?x :w ?w FILTER NOT EXISTS { ?x :w ?v } } }") == [('"1"^integer>',), ('"2"^integer>',), ('"3"^integer>',)]
    assert ask(spark, data, "SELECT ?v { ?s :v ?v FILTER NOT EXISTS { ?x :w ?w FILTER EXISTS { ?x :w ?v } } }") == [('"1"^integer>',)]


def test_optional_with_exists(spark):
    data = ":a :v 1 . :b :v 2 . :a :q 5 . :b :q 6 . :x :w 1 . GRAPH :g { :a :v 1 . :a :q 7 . :x :w 1 }"
    found = [("<a>", '"5"^integer>'), ("<b>", None)]
    assert ask(spark, data, "SELECT ?s ?q { ?s :v ?v OPTIONAL { ?s :q ?q FILTER EXISTS { ?x :w ?v } } }") == found
    assert ask(spark, data, "SELECT ?s ?q { GRAPH :g { ?s :v ?v OPTIONAL { ?s :q ?q FILTER EXISTS { ?x :w ?v } } } }") == [("<a>", '"7"^integer>')]


def test_loose_joins(spark):
    """Every way of meeting over a variable that may be unbound, against all pairs."""
    import itertools

    left, right = [("1", "a"), (None, "b"), ("2", None), (None, None)], [("1", "a"), ("2", "c"), (None, "a"), (None, None)]
    values = lambda names, rows: "VALUES (" + " ".join("?" + n for n in names) + ") { " + " ".join("(" + " ".join("UNDEF" if x is None else f"'{x}'" for x in r) + ")" for r in rows) + " }"
    a, b = values("xy", left), values("xy", right)
    meet = lambda p, q: all(i is None or j is None or i == j for i, j in zip(p, q, strict=True))
    one = lambda p, q: tuple(None if v is None else f'"{v}"' for v in (i if i is not None else j for i, j in zip(p, q, strict=True)))
    term = lambda p: one(p, p)
    key = lambda rows: sorted(rows, key=str)
    pairs = [(p, q) for p, q in itertools.product(left, right) if meet(p, q)]
    assert ask(spark, "", f"SELECT ?x ?y {{ {{ {a} }} {{ {b} }} }}") == key(one(*x) for x in pairs)
    alone = [p for p in left if not any(meet(p, q) for q in right)]
    assert ask(spark, "", f"SELECT ?x ?y {{ {{ {a} }} OPTIONAL {{ {b} }} }}") == key([one(*x) for x in pairs] + [term(p) for p in alone])
    common = lambda p, q: any(i is not None and j is not None for i, j in zip(p, q, strict=True))
    assert ask(spark, "", f"SELECT ?x ?y {{ {{ {a} }} MINUS {{ {b} }} }}") == key(term(p) for p in left if not any(meet(p, q) and common(p, q) for q in right))
    assert ask(spark, "", f"SELECT ?x ?y {{ {{ {a} }} FILTER EXISTS {{ {b} }} }}") == key(term(p) for p in left if any(meet(p, q) for q in right))
    certain = values("xy", [("1", "a"), ("2", "c"), ("3", "b")])
    rows = [("1", "a"), ("2", "c"), ("3", "b")]
    for how, want in (("OPTIONAL", [one(p, q) for p in left for q in rows if meet(p, q)] + [term(p) for p in left if not any(meet(p, q) for q in rows)]), ("MINUS", [term(p) for p in left if not any(meet(p, q) and common(p, q) for q in rows)])):
        assert ask(spark, "", f"SELECT ?x ?y {{ {{ {a} }} {how} {{ {certain} }} }}") == key(want)


def test_patterns_that_are_errors(spark):
    data = ":a :v 'abab' ; :p '(' ; :q 'a.' ."
    one = lambda e: ask(spark, data, f"SELECT (COALESCE({e}, 'error') AS ?r) {{ :a :v ?v ; :p ?p ; :q ?q }}")[0][0]
    assert one("REPLACE(?v, 'b', 'a$b')") == '"error"'
    assert one("REPLACE(?v, '(a)', '$2')") == '"error"'
    assert one("REPLACE(?v, '(a)b', '$1-')") == '"a-a-"'
    assert one(r"REPLACE(?v, 'b', '\\$')") == '"a$a$"'
    assert one("REPLACE(?v, 'x*', '-')") == '"error"'
    assert one("REPLACE(?v, ?q, 'z')") == '"zz"'
    assert one("REPLACE(?v, ?p, 'z')") == one("REGEX(?v, ?p)") == one("REGEX(?v, '[')") == '"error"'


def test_scans_are_filtered(spark, tmp_path):
    """Comparisons, constants and keys reach the tables that terms are made of."""
    from quadmill.plans.mapping import Mapped, Table

    spark.createDataFrame([(i, f"n{i}", i * 10.0, i % 3) for i in range(9)], "k long, name string, x double, up int").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(i, f"u{i}") for i in range(3)], "u_k long, u_name string").write.parquet(str(tmp_path / "u"))
    store_ = Mapped([Table("t", spark.read.parquet(str(tmp_path / "t")), ["k"], {"up": "u"}), Table("u", spark.read.parquet(str(tmp_path / "u")), ["u_k"])])

    def plan(text):
        df = sparql(spark, store_, text)
        return df, df._jdf.queryExecution().toString()

    df, shown = plan("SELECT ?s { ?s <urn:t:x> ?x FILTER(?x > 50) }")
    assert df.count() == 3 and "GreaterThan(x,50.0)" in shown
    df, shown = plan("SELECT ?n { <urn:t:t:4> <urn:t:name> ?n }")
    assert [r[0] for r in df.collect()] == ['"n4"'] and "EqualTo(k,4)" in shown
    df, shown = plan("SELECT ?s { ?s <urn:t:name> 'n5' }")
    assert df.count() == 1 and "EqualTo(name,n5)" in shown
    df, shown = plan("SELECT ?s ?n { ?s <urn:t:up> ?u . ?u <urn:t:u_name> ?n }")
    assert df.count() == 9 and "NestedLoop" not in shown and "concat" not in shown[shown.index("Join", shown.index("Physical Plan")) :].splitlines()[0]


def test_turtle_lines(spark, tmp_path):
    """Lines over many partitions are the text that one row would hold."""
    facts = store(spark, " ".join(f":s{i % 7} :p{i % 3} 'x{i}', :o{i} ." for i in range(40))).repartition(5)
    own = {"": "http://e/", "z": "urn:z:"}
    text = sinks.turtle(facts, own).first().text
    assert "\n".join(r.line for r in sinks.turtle_lines(facts, own).collect()) + "\n" == text
    sinks.write_turtle(facts, str(tmp_path / "out"), own)
    parts = sorted((tmp_path / "out" / "doc_id=d").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == text


def test_byte_order_marks(spark, tmp_path):
    (tmp_path / "f.nt").write_text("﻿<a:a> <b:b> <c:c> .\n<a:a> <b:b> <d:d> .\n", encoding="utf-8")
    rows = reader.read_lines(spark, str(tmp_path / "f.nt")).collect()
    assert len(rows) == 2 and all(r.error is None for r in rows)
    assert sorted(r.src_offset for r in rows) == [3, 23] and "ANY-BOM-001" in reader.line_files(reader.line_places(spark, str(tmp_path / "f.nt"))).first().warnings[0]
    stray = spark.createDataFrame([("f", 7, "﻿<a:a> <b:b> <c:c> .")], "doc_id string, src_offset long, line string")
    assert "NT-BOM-001" in reader.line_facts(stray).first().error


def test_offsets_of_split_files(spark, tmp_path):
    """Files of many splits, ends of both kinds, long lines, marks and no last line feed: each line begins where its offset says."""
    import gzip
    import random

    rng, want = random.Random(91), {}
    (tmp_path / "in").mkdir()
    for name, end, mark, last in (("a.nt", "\n", "", "\n"), ("b.nt", "\r\n", "\ufeff", ""), ("c.nt", "\n", "\ufeff", "\n"), ("d.nt", "\n", "", ""), ("e.nt.gz", "\n", "", "\n")):
        lines = [rng.choice([f"<a:{i}> <b:b> <c:c> .", f"<a:{i}>  <b:b>  \"é{'x' * rng.randrange(400)}\".", "# no fact", "", f"<a:{i}> <b:b> \"q\\\"\" . # more"]) for i in range(rng.randrange(60, 200))]
        content = (mark + end.join(lines) + last).encode()
        (tmp_path / "in" / name).write_bytes(gzip.compress(content) if name.endswith("gz") else content)
        for i, line in enumerate(lines):
            if line.startswith("<"):
                want[name, f"<a:{i}>"] = content.index(f"<a:{i}>".encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        places = reader.line_places(spark, str(tmp_path / "in"))
        assert places.count() > 20
        rows = reader.read_lines(spark, str(tmp_path / "in"), places=places).collect()
        bare = reader.read_lines(spark, str(tmp_path / "in"), offsets=False).collect()
        files = {r.doc_id.rpartition("/")[2]: r.warnings for r in reader.line_files(places).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r.doc_id.rpartition("/")[2], r.s): r.src_offset for r in rows} == want and len(rows) == len(want)
    assert len(bare) == len(rows) and all(r.src_offset is None for r in bare)
    assert {n for n, w in files.items() if w} == {"b.nt", "c.nt"} and len(files) == 5


def test_plans_of_many_operations(spark):
    """The plan after many operations is as small as after a few, and the facts are those of a plain set."""
    from quadmill.plans.update import Updater

    facts = spark.createDataFrame([(f"<s:{i}>", "<p:p>", f'"{i}"', None) for i in range(30)] * 2, "s string, p string, o string, g string")
    own, store, sizes = {(f"<s:{i}>", "<p:p>", f'"{i}"', None) for i in range(30)}, Updater(spark, facts), []
    for i in range(9):
        store.run(f"DELETE {{ ?s <p:p> '{i}' }} INSERT {{ ?s <p:q> '{i}' ; <p:p> '{i + 1}' }} WHERE {{ ?s <p:p> '{i}' }}")
        gone = {q for q in own if q[1:3] == ("<p:p>", f'"{i}"')}
        own = own - gone | {(s, "<p:q>", f'"{i}"', None) for s, *_ in gone} | {(s, "<p:p>", f'"{i + 1}"', None) for s, *_ in gone}
        sizes.append(len(store.facts._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sorted(map(tuple, store.facts.collect()), key=str) == sorted(own, key=str) and max(sizes[1:]) <= min(sizes[1:]) + 2
    for text, left in (("INSERT DATA { <s:x> <p:p> 1 } ; DELETE DATA { <s:x> <p:p> 1 }", 0), ("DELETE DATA { <s:x> <p:p> 1 } ; INSERT DATA { <s:x> <p:p> 1 . <s:x> <p:p> 1 }", 1), ("INSERT DATA { <s:x> <p:p> 1 }", 1), ("CLEAR DEFAULT ; INSERT DATA { <s:x> <p:p> 1 }", 1)):
        assert store.run(text).where("s = '<s:x>'").count() == left
    assert store.facts.count() == 1
