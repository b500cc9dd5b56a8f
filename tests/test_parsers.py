"""Documents to quads: what is taken, what is turned down, and what comes out."""

import pytest

from quadmill.plans.datalog import DatalogError, parse_datalog, stratify
from quadmill.plans.shex import parse_shex
from quadmill.plans.sparql_parser import SparqlError, parse_query, parse_update
from quadmill.sources.reader import parse_document

X = "http://www.w3.org/2001/XMLSchema#"
R = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def quads(text, lang, base=None):
    return parse_document(text.encode(), lang, base)[0]


@pytest.mark.parametrize(
    "text",
    ["<a:a> <b:b> <c:c> .", '<a:a> <b:b> "x"@EN-latn-us .', '_:x <b:b> "\\u00e9\\n" . # end', "# only a comment", "", '<a:a> <b:b> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<a:a> <b:b> _:y.z .', "<a:a> <b:b> <c:c> . <a:a> <b:b> <d:d> ."],
)
def test_ntriples_accepted(text):
    quads(text, "nt")


@pytest.mark.parametrize("text", ["<a> <b:b> <c:c> .", '"l" <b:b> <c:c> .', "<a:a> _:b <c:c> .", "<a:a> <b:b> <c:c>", '<a:a> <b:b> "\\uD800" .', "<a:a> <b:b> 'x' .", "<a:a> <b:b>\n<c:c> .", '<a:a> <b:b> "x\ny" .', "<a:a> <b:b> 1 ."])
def test_ntriples_rejected(text):
    with pytest.raises(ValueError):
        quads(text, "nt")


def test_byte_order_mark():
    assert parse_document("﻿<a:a> <b:b> <c:c> .".encode(), "nt", None)[1]
    with pytest.raises(ValueError):
        quads("<a:a> <b:b> <c:c> .\n﻿", "nt")


def test_language_tags_fold():
    tags = {"EN-latn-us": "en-Latn-US", "zh-HANT-tw": "zh-Hant-TW", "de-1996": "de-1996", "x-PRIVATE": "x-private", "es-419": "es-419"}
    for raw, want in tags.items():
        assert quads(f'<a:a> <b:b> "x"@{raw} .', "nt")[0][2] == f'"x"@{want}'


def test_turtle_terms():
    got = quads("@base <http://b/c/> . @prefix : <#> . <x> a :T ; :p 1, 2.5, 1e3, true, 'q', \"\"\"a\"b\"\"\" . [] :q ( ) .", "ttl")
    objects = [o for _, _, o, _ in got]
    assert objects == ["<http://b/c/#T>", f'"1"^^<{X}integer>', f'"2.5"^^<{X}decimal>', f'"1e3"^^<{X}double>', f'"true"^^<{X}boolean>', '"q"', '"a\\"b"', f"<{R}nil>"]
    assert got[0][0] == "<http://b/c/x>"


def test_turtle_collections_and_property_lists():
    got = quads("<a:a> <b:b> (1 [ <c:c> 2 ]) .", "ttl")
    assert len(got) == 6 and sum(p == f"<{R}rest>" for _, p, _, _ in got) == 2


@pytest.mark.parametrize("text", ["<a> <b:b> <c:c> .", "x:a <b:b> <c:c> .", "<a:a> <b:b> .", "<a:a> <b:b> <c:c>", "'l' <b:b> <c:c> .", "<a:a> <b:b> 'unclosed ."])
def test_turtle_rejected(text):
    with pytest.raises(ValueError):
        quads(text, "ttl")


def test_trig_graphs():
    got = quads("@prefix : <http://e/> . { :a :b :c } :g { :a :b 1 . } GRAPH _:x { :a :b 2 } [] { :a :b 3 }", "trig")
    assert [g for *_, g in got][:2] == [None, "<http://e/g>"] and got[2][3].startswith("_:")


def test_n3_formulas_and_inverse():
    got = quads("@prefix : <http://e/> . { ?x :p :y } => { ?x :q :z } . :a is :child of :b .", "n3")
    assert got[-1] == ("<http://e/b>", "<http://e/child>", "<http://e/a>", None)
    assert sum(p.endswith("log#implies>") for _, p, _, _ in got) == 1 and len({g for *_, g in got}) == 3


def test_rdf_xml():
    text = f'<rdf:RDF xmlns:rdf="{R}" xmlns:e="http://e/" xml:base="http://b/"><e:C rdf:ID="x" e:attr="v"><e:p rdf:resource="y"/><e:q rdf:parseType="Collection"><rdf:Description rdf:about="z"/></e:q><e:r rdf:parseType="Resource"><e:s>t</e:s></e:r><rdf:li xml:lang="EN">1</rdf:li><e:t rdf:datatype="{X}int" rdf:ID="st">7</e:t></e:C></rdf:RDF>'
    got = quads(text, "rdfxml")
    assert ("<http://b/#x>", f"<{R}type>", "<http://e/C>", None) in got
    assert ("<http://b/#x>", f"<{R}_1>", '"1"@en', None) in got
    assert ("<http://b/#st>", f"<{R}object>", f'"7"^^<{X}int>', None) in got
    assert len(got) == 14
    for bad in ('<rdf:li xmlns:rdf="%s"/>' % R, f'<rdf:RDF xmlns:rdf="{R}"><rdf:Description rdf:about="a" rdf:nodeID="b"/></rdf:RDF>', "<a", f'<rdf:RDF xmlns:rdf="{R}" xml:base="http://b/"><rdf:Description rdf:ID="a"/><rdf:Description rdf:ID="a"/></rdf:RDF>'):
        with pytest.raises(ValueError):
            quads(bad, "rdfxml")


def test_json_ld():
    text = '{"@context": {"@vocab": "http://v/", "e": "http://e/", "d": {"@id": "e:d", "@type": "@id"}, "l": {"@id": "e:l", "@container": "@list"}}, "@id": "http://a", "@type": "T", "d": "http://o", "l": [1, 2.5], "n": {"@value": "x", "@language": "EN"}, "@graph": [{"@id": "http://b", "p": true}]}'
    got = quads(text, "jsonld")
    assert ("<http://b>", "<http://v/p>", f'"true"^^<{X}boolean>', "<http://a>") in got
    assert ("<http://a>", "<http://e/d>", "<http://o>", None) in got and ("<http://a>", "<http://v/n>", '"x"@en', None) in got
    assert any(o == f'"2.5E0"^^<{X}double>' for _, _, o, _ in got)
    with pytest.raises(ValueError):
        quads("{", "jsonld")


def test_trix():
    text = '<TriX><graph><uri>g:g</uri><triple><id>x</id><uri>p:p</uri><plainLiteral xml:lang="en">t</plainLiteral></triple></graph></TriX>'
    assert quads(text, "trix") == [("_:x", "<p:p>", '"t"@en', "<g:g>")]
    with pytest.raises(ValueError):
        quads("<TriX><graph><triple><uri>a:a</uri></triple></graph></TriX>", "trix")


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT * WHERE { ?s ?p ?o } GROUP BY ?s", "AGG"), ("SELECT ?p WHERE { ?s ?p ?o } GROUP BY ?s", "AGG"), ("SELECT ?s WHERE { ?s ?p ?o BIND(1 AS ?o) }", "BIND"), ("SELECT ?s { ?s x:p ?o }", "PFX"),
        ("SELECT (1 AS ?x) (2 AS ?x) {}", "AGG"), ("SELECT ?s { VALUES (?a ?b) { (1) } }", "SYNTAX"), ("SELECT ?s {", "EOF"), ("SELECT ?s { { PREFIX x: <y> } }", "PROLOGUE"), ("SELECT (STRLEN() AS ?x) {}", "SYNTAX"), ("ASK { ?s ?p 'a\\q' }", "LITESC"),
    ],
)
def test_sparql_rejected(text, code):
    with pytest.raises(SparqlError) as e:
        parse_query(text)
    assert code in e.value.code


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * { ?s ?p ?o }", "PREFIX : <http://e/> SELECT ?x (COUNT(*) AS ?n) FROM <g:g> FROM NAMED <h:h> WHERE { ?x :p/:q*|^:r+ ?y ; !(:a|^:b) 'x'@en . [] :p (1 2) OPTIONAL { ?y a :T } } GROUP BY ?x HAVING (?n > 1) (?n < 9) ORDER BY DESC(?n) ?x LIMIT 3 OFFSET 1",
        "CONSTRUCT WHERE { ?s ?p ?o }", "DESCRIBE <a:a>", "ASK { FILTER(1 IN (1, 2) && NOT EXISTS { ?s ?p ?o }) }", "SELECT ?s { { SELECT ?s { ?s ?p ?o } LIMIT 1 } UNION { ?s ?p 1.5e3 } MINUS { ?s ?p -1 } } VALUES ?s { <a:a> UNDEF }",
        "SELECT (GROUP_CONCAT(DISTINCT ?o ; SEPARATOR = ', ') AS ?x) { ?s ?p ?o }", "SELECT ?s { SERVICE SILENT <s:s> { ?s ?p ?o } GRAPH ?g { ?s ?p ?o } }",
    ],
)
def test_sparql_accepted(text):
    parse_query(text)


def test_updates():
    ops = parse_update("PREFIX : <http://e/> INSERT DATA { :a :b _:x } ; DELETE WHERE { ?s ?p ?o } ; WITH :g DELETE { ?s :p ?o } INSERT { ?s :q ?o } USING :h WHERE { ?s :p ?o } ; CLEAR SILENT ALL ; COPY DEFAULT TO :g ; LOAD <f:f> INTO GRAPH :g ; CREATE GRAPH :n")
    assert [op[0] for op in ops] == ["insert data", "modify", "modify", "clear", "copy", "load", "create"]
    for bad in ("INSERT DATA { ?x <b:b> 1 }", "DELETE DATA { _:x <b:b> 1 }", "INSERT DATA { GRAPH ?g { <a:a> <b:b> 1 } }", "INSERT DATA { _:x <b:b> 1 } ; INSERT DATA { _:x <b:b> 2 }"):
        with pytest.raises(SparqlError):
            parse_update(bad)


def test_datalog():
    assert len(parse_datalog('p(X) :- q(X, "a"), not r(X). q(a, "a"). % end')) == 2
    with pytest.raises(DatalogError):
        stratify(parse_datalog("p(X) :- q(X), not p(X)."))
    with pytest.raises(DatalogError):
        parse_datalog("p(X :- q(X).")


def test_shex():
    s = parse_shex('PREFIX e: <http://e/> START = @e:S e:S CLOSED EXTRA e:x { e:p IRI * ; (e:q [1 "a"@en e:~] | ^e:r . {2,3}) ; } e:T @e:S AND NOT { e:z xsd:x } ABSTRACT e:U {}'.replace("xsd:x", "e:x"))
    assert set(s.shapes) == {"<http://e/S>", "<http://e/T>", "<http://e/U>"} and s.abstract
    with pytest.raises(ValueError):
        parse_shex("<S> { <p> IRI ")


def test_plain_statements_are_no_shortcut(monkeypatch):
    """What one match takes whole gives what the tokens give, wherever a statement stops being plain."""
    import itertools

    from quadmill.sources import rdf_text

    heads = ["e:s", "<http://e/x>", "_:b", "[]", ":z"]
    values = ["e:o", '"x"', '"x"@EN-us', '"1"^^xsd:integer', '"x"^^xsd:string', "7", "-3", "1.5", "true", "(1 2)", "[ e:q 1 ]", r'"a\nb"', '"""x"y"""', "e:o.x", "_:c", "e:a\\-b", "'q'"]
    tails = [".", " .", ". # no\n", " ; .", ' ; a e:T .', " , 5 .", ' ;; e:r "y" , [] ; e:u 2 .', "\n;\n e:r e:t\n.\n"]
    texts = ["@prefix e: <http://e/> . @prefix : <urn:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n" + "\n".join(f"{h} e:p {v}{t}" for v, t in itertools.product(values, tails)) for h in heads]
    texts += [texts[0] + " @prefix e: <http://f/> . e:s e:p e:o . e:s e:p e:o", texts[0] + " nope:s e:p 1 .", texts[0] + ' e:s e:p "x" "y" .', texts[0] + " <rel> e:p <#y> ."]

    def told(text, base):
        try:
            return rdf_text.parse_text(text, "ttl", base)
        except rdf_text.RdfError as e:
            return e.code

    for base in ("http://b/", None):
        fast = [told(t, base) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(rdf_text.TextParser, "plain", lambda self: False)
            assert [told(t, base) for t in texts] == fast
    assert sum(isinstance(x, str) for x in fast) == 4


def test_a_request_is_cut_into_words_once(monkeypatch):
    from quadmill.plans import sparql_encode

    made, parser = [], sparql_encode.Parser
    monkeypatch.setattr(sparql_encode, "Parser", lambda *a: made.append(a) or parser(*a))
    for text in ("BASE <http://b/> PREFIX e: <x#> SELECT * { ?x e:p <y> }", "PREFIX e: <http://b/x#> BASE <http://b/> INSERT DATA { <a> e:p <y> }"):
        made.clear()
        facts = sparql_encode.encode_sparql(text)
        assert len(made) == 1
        assert [f[2] for f in facts if f[1].endswith(("prefix>", "base>"))] == ['"http://b/"', '"e -> http://b/x#"']


def words_one_by_one(token, text):
    """(kind, word, offset) of all words, and where the first stands that is none."""
    out, at = [], 0
    while at < len(text) and (m := token.match(text, at)):
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out, at


def test_words_found_together_are_those_found_one_by_one(monkeypatch):
    import random

    from quadmill.plans import shex, sparql_parser

    monkeypatch.setattr(sparql_parser, "REMEMBERED", 40)
    rng = random.Random(3)
    parts = ["SELECT", "a", "true", "e:", "e:x", ":", "e:x.y", "a-b:c-d", "?v", "@en", "@en-us", "@", "12", "1.5e3", "-", "+", ".", ";", ",", "{", "}", "(", ")", "[", "]", "<u:x>", "<", ">", '"s"', "'", '"""x"y"""', "#c\n", "/*c*/", " ", "\n", "\u00a0", "é", "éa:b", "_:b", "^^", "&&", "||", "%41", "\\", "~", "$", "x" * 70]
    whole = 0
    for token in (sparql_parser.TOKEN, shex.TOKEN):
        words = sparql_parser.Words(token)
        for _ in range(3000):
            text = "".join(rng.choice([x, x + " "]) for x in rng.choices(parts, k=rng.randint(0, 9)))
            pieces, at = words.cut(text)
            want, end = words_one_by_one(token, text)
            assert at == end, text
            if end == len(text):
                whole += 1
                found = words.tokens(pieces)
                assert [(kind, word) for kind, word, _ in found[:-2]] == [x[:2] for x in want], text
                assert [words.offset(pieces, n) for n in range(len(found) - 1)] == [*(x[2] for x in want), len(text)]
            assert len(words) <= 40 and all(len(x) <= sparql_parser.LONGEST for x in words)
    assert whole > 1000


def test_a_word_seen_before_is_not_told_again(monkeypatch):
    from quadmill.plans import shex

    asked, missing = [], shex.Words.__missing__
    monkeypatch.setattr(shex.Words, "__missing__", lambda self, text: asked.append(text) or missing(self, text))
    for n in range(100_000, 100_050):
        parse_shex(f"PREFIX e: <http://e/> <http://e/S> CLOSED EXTRA e:p {{ e:p IRI {{{n},}} ; e:q [ 1 2 ] ? }}")
    assert len(asked) < 50 + 30


def test_usual_declarations_say_what_others_say(monkeypatch):
    """Declarations in one match are those taken word by word: the same facts, the same errors at the same places."""
    from quadmill.sources import rdf_text

    heads = ["@prefix e: <u:e> .", "@prefix e:<u:e>.", "@prefix : <u:n> .\n@prefix e: <u:e> .", "@prefix e: # c\n <u:e> .", "@prefix e: <rel> .", "@prefix e: <u:\\u0041> .", "@prefix e: <u:1> . @prefix e: <u:2> .", "@prefix e-f: <u:e> . @prefix e: <u:3> .", "@prefix e: <u:e> .5", "@prefix e: <u:e>", "@prefix e <u:e> .", "@prefix e: <u:a b> .", "@prefixe: <u:e> .", "@prefix e: <u:e> . @base <u:/b> .", "PREFIX e: <u:e>", "@prefix e.f: <u:e> ."]
    tails = [" e:x e:y 1 .", "\ne:x e:y e:z . @prefix e: <u:9> .\ne:x e:y 'z' .", "", " .", " <a> e:y 2 ."]
    matched = []

    def told(text, lang, base):
        try:
            return rdf_text.parse_text(text, lang, base)
        except rdf_text.RdfError as e:
            return str(e)

    cases = [(h + t, lang, base) for h in heads for t in tails for lang in ("ttl", "trig", "n3") for base in ("http://b/", None)]
    declarations = rdf_text.TextParser.declarations
    monkeypatch.setattr(rdf_text.TextParser, "declarations", lambda self: matched.append(declarations(self)) or matched[-1])
    fast = [told(*c) for c in cases]
    monkeypatch.setattr(rdf_text.TextParser, "declarations", lambda self: False)
    assert [told(*c) for c in cases] == fast
    assert sum(matched) > 100 and sum(isinstance(x, str) for x in fast) > 50
