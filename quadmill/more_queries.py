"""More registered queries: front-ends, encodings, errors and the analysis of documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import iri as I
from .functions import terms as T
from .operators import documents as D
from .operators import facts as O
from .plans.datalog import datalog
from .plans.mapping import Facts, mapped
from .plans.shex import validate
from .plans.sparql import sparql
from .plans.stars import Stars
from .plans.update import update
from .queries import BASE_SQL, INTEGER, QUERIES, RDFNS, RING, SQL, K, ask, decoded, parsed_query, rdf_docs, register, ring, shex, table
from .session import dealt, new_folder
from .sources import reader, sinks
from .sources.statements import reparsed

XSD = "http://www.w3.org/2001/XMLSchema#"


def facts_sql(*facts: tuple[str, str, str], source: str = "customer", doc: str = "'c' || c_custkey") -> str:
    """SQL of the facts of one document a row, told as expressions."""
    return " UNION ALL ".join(f"SELECT {doc} AS doc_id, {s} AS s, {p} AS p, {o} AS o FROM {source}" for s, p, o in facts)


def q(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def told(pattern: str) -> Column:
    """A text in which KEY stands for the customer's number and NAME for its name."""
    return F.replace(F.replace(F.lit(pattern), F.lit("KEY"), K()), F.lit("NAME"), F.col("c_name"))


def document(name: str, lang: str, pattern: str, *facts: tuple[str, str, str]) -> None:
    """Registers the parsing of one small document a customer; facts are told in the same way."""

    def sql(text: str) -> str:
        return f"replace(replace({q(text)}, 'KEY', c_custkey::VARCHAR), 'NAME', c_name)"

    parsed_query(name, lang, lambda: told(pattern), facts_sql(*(tuple(sql(x) for x in f) for f in facts)))


# -- Turtle and its kin
document("parse_bnodes", "ttl", "_:x <http://e/p> _:y . _:y <http://e/p> _:x . _:x <http://e/n> KEY .", ("_:c0", "<http://e/n>", f'"KEY"{INTEGER}'), ("_:c0", "<http://e/p>", "_:c1"), ("_:c1", "<http://e/p>", "_:c0"))
document("parse_property_list", "ttl", '<http://e/KEY> <http://e/p> [ <http://e/q> "NAME" ] .', ("<http://e/KEY>", "<http://e/p>", "_:c0"), ("_:c0", "<http://e/q>", '"NAME"'))
document("parse_n3_formula", "n3", "@prefix e: <http://e/> . e:KEY => e:x . e:x = e:y . e:a is e:of of e:KEY .", ("<http://e/KEY>", "<http://www.w3.org/2000/10/swap/log#implies>", "<http://e/x>"), ("<http://e/x>", "<http://www.w3.org/2002/07/owl#sameAs>", "<http://e/y>"), ("<http://e/KEY>", "<http://e/of>", "<http://e/a>"))


@register(" UNION ALL ".join(f"SELECT c_custkey AS k, '{side}' AS side, {s} AS s, 'http://e/{p}' AS p FROM customer" for side, s, p in (("if", "'http://e/' || c_custkey", "p"), ("if", "'http://e/q'", "r"), ("then", "'http://e/' || c_custkey", "t"))))
def parse_n3_braces(spark, sf_dir):
    """Formulas in braces: what they hold stands in the graphs that an implication joins."""
    docs = table(spark, sf_dir, "customer").select(K().alias("path"), F.lit("n3").alias("lang"), told("@prefix e: <http://e/> . { e:KEY e:p 1 . e:q e:r e:s } => { e:KEY e:t e:u } .").alias("content"))
    facts = reader.facts_of(reader.parse(docs))
    rule = facts.where("p = '<http://www.w3.org/2000/10/swap/log#implies>' AND g IS NULL").select("doc_id", F.explode(F.array(F.struct(F.lit("if").alias("side"), F.col("s").alias("g")), F.struct(F.lit("then").alias("side"), F.col("o").alias("g")))).alias("x"))
    return facts.join(rule.select("doc_id", "x.side", "x.g"), ["doc_id", "g"]).select(F.col("doc_id").cast("long").alias("k"), "side", T.iri_text(F.col("s")).alias("s"), T.iri_text(F.col("p")).alias("p"))


@register("SELECT 'c' || c_custkey AS path, 'http://b/' || c_custkey || '/x' AS s, 'http://b/p' AS p FROM customer")
def parse_with_base(spark, sf_dir):
    """References are resolved against the base that a document is told to have."""
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), K()).alias("path"), F.lit("ttl").alias("lang"), F.concat(F.lit("http://b/"), K(), F.lit("/doc")).alias("base"), F.lit("<x> <../p> 1 .").alias("content"))
    return reader.facts_of(reader.parse(docs)).select(F.col("doc_id").alias("path"), T.iri_text(F.col("s")).alias("s"), T.iri_text(F.col("p")).alias("p"))


@register("SELECT c_custkey AS k, c_custkey % 3 < 2 AS accepted, CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS warnings FROM customer")
def parse_bom(spark, sf_dir):
    """A byte order mark is skipped with a warning where a document begins, and an error within."""
    mark = F.lit("﻿")
    line = F.lit("<urn:s> <urn:p> <urn:o> .\n")
    text = F.when(F.col("c_custkey") % 3 == 0, line).when(F.col("c_custkey") % 3 == 1, F.concat(mark, line)).otherwise(F.concat(line, mark, line))
    docs = table(spark, sf_dir, "customer").select(K().alias("path"), F.lit("nt").alias("lang"), text.alias("content"))
    return reader.parse(docs).select(F.col("path").cast("long").alias("k"), "accepted", F.size("warnings").alias("warnings"))


# -- RDF/XML
RDF = f'<rdf:RDF xmlns:rdf="{RDFNS}" xmlns:e="http://e/" '
TYPE = f"<{RDFNS}type>"
document("rdfxml_elements", "rdfxml", RDF + '><e:C rdf:about="http://e/KEY" e:attr="NAME"><e:r rdf:resource="http://e/r"/><e:n rdf:parseType="Resource"><e:m>1</e:m></e:n><e:t rdf:datatype="http://e/d">x</e:t></e:C></rdf:RDF>', ("<http://e/KEY>", TYPE, "<http://e/C>"), ("<http://e/KEY>", "<http://e/attr>", '"NAME"'), ("<http://e/KEY>", "<http://e/r>", "<http://e/r>"), ("<http://e/KEY>", "<http://e/n>", "_:c0"), ("_:c0", "<http://e/m>", '"1"'), ("<http://e/KEY>", "<http://e/t>", '"x"^^<http://e/d>'))
document("rdfxml_collection", "rdfxml", RDF + '><rdf:Description rdf:about="http://e/KEY"><e:l rdf:parseType="Collection"><rdf:Description rdf:about="http://e/a"/></e:l></rdf:Description></rdf:RDF>', ("<http://e/KEY>", "<http://e/l>", "_:c0"), ("_:c0", f"<{RDFNS}first>", "<http://e/a>"), ("_:c0", f"<{RDFNS}rest>", f"<{RDFNS}nil>"))
document("rdfxml_reification", "rdfxml", RDF + 'xml:base="http://b/"><rdf:Description rdf:about="http://e/KEY"><e:p rdf:ID="st">NAME</e:p></rdf:Description></rdf:RDF>', ("<http://e/KEY>", "<http://e/p>", '"NAME"'), ("<http://b/#st>", TYPE, f"<{RDFNS}Statement>"), ("<http://b/#st>", f"<{RDFNS}subject>", "<http://e/KEY>"), ("<http://b/#st>", f"<{RDFNS}predicate>", "<http://e/p>"), ("<http://b/#st>", f"<{RDFNS}object>", '"NAME"'))
document("rdfxml_scopes", "rdfxml", RDF + 'xml:base="http://b/x/"><rdf:Description rdf:about="KEY" xml:lang="EN-us"><e:p>NAME</e:p><e:p xml:lang="">bare</e:p><f:q xmlns:f="http://f/" rdf:resource="../y"/></rdf:Description></rdf:RDF>', ("<http://b/x/KEY>", "<http://e/p>", '"NAME"@en-US'), ("<http://b/x/KEY>", "<http://e/p>", '"bare"'), ("<http://b/x/KEY>", "<http://f/q>", "<http://b/y>"))


@register("SELECT c_custkey AS k, c_custkey % 3 = 0 AS accepted FROM customer")
def rdfxml_forbidden(spark, sf_dir):
    """Names that RDF/XML forbids, and one ID twice."""
    head = RDF + 'xml:base="http://b/">'
    bad = F.when(F.col("c_custkey") % 3 == 1, "<rdf:li/>").when(F.col("c_custkey") % 3 == 2, '<rdf:Description rdf:ID="a"/><rdf:Description rdf:ID="a"/>').otherwise('<rdf:Description rdf:ID="a"/>')
    docs = table(spark, sf_dir, "customer").select(K().alias("path"), F.lit("rdfxml").alias("lang"), F.concat(F.lit(head), bad, F.lit("</rdf:RDF>")).alias("content"))
    return reader.parse(docs).select(F.col("path").cast("long").alias("k"), "accepted")


# -- JSON-LD
document("jsonld_iris", "jsonld", '{"@context": {"@base": "http://b/x/", "@vocab": "http://v/", "e": "http://e/"}, "@id": "KEY", "e:p": {"@id": "../y"}, "q": {"@id": "e:z"}}', ("<http://b/x/KEY>", "<http://e/p>", "<http://b/y>"), ("<http://b/x/KEY>", "<http://v/q>", "<http://e/z>"))
document("jsonld_values", "jsonld", '{"@context": {"@vocab": "http://v/", "n": {"@type": "http://e/t"}}, "@id": "http://e/KEY", "a": KEY, "b": true, "c": {"@value": "NAME", "@language": "en"}, "n": "x", "d": 1.5}', ("<http://e/KEY>", "<http://v/a>", f'"KEY"{INTEGER}'), ("<http://e/KEY>", "<http://v/b>", f'"true"^^<{XSD}boolean>'), ("<http://e/KEY>", "<http://v/c>", '"NAME"@en'), ("<http://e/KEY>", "<http://v/n>", '"x"^^<http://e/t>'), ("<http://e/KEY>", "<http://v/d>", f'"1.5E0"^^<{XSD}double>'))
document("jsonld_structures", "jsonld", '{"@context": {"@vocab": "http://v/"}, "@id": "http://e/KEY", "@type": "T", "l": {"@list": ["NAME"]}, "@reverse": {"r": {"@id": "http://e/o"}}}', ("<http://e/KEY>", TYPE, "<http://v/T>"), ("<http://e/KEY>", "<http://v/l>", "_:c0"), ("_:c0", f"<{RDFNS}first>", '"NAME"'), ("_:c0", f"<{RDFNS}rest>", f"<{RDFNS}nil>"), ("<http://e/o>", "<http://v/r>", "<http://e/KEY>"))


# -- syntaxes as facts
def encoded(name: str, lang: str, pattern: str, subject: str, *facts: tuple[str, str]) -> None:
    document(name, lang, pattern, *((subject, p, o) for p, o in facts))


S = "urn:x-sparql-syntax:"
encoded(
    "encode_sparql_query", "sparql", "PREFIX e: <http://e/> SELECT DISTINCT ?n (COUNT(?o) AS ?c) WHERE { ?x e:name ?n . ?x e:KEY/e:q* ?o OPTIONAL { ?x e:p 5 } FILTER(?n != 'z' && STRLEN(?n) > 3) } GROUP BY ?n HAVING (COUNT(?o) > KEY) ORDER BY DESC(?n) LIMIT 7",
    f"<{S}request>",
    (f"<{S}kind>", '"query"'), (f"<{S}prefix>", '"e -> http://e/"'), (f"<{S}form>", '"SELECT"'), (f"<{S}select-modifier>", '"DISTINCT"'), (f"<{S}projection>", '"?n"'), (f"<{S}projection>", '"(COUNT(?o) AS ?c)"'),
    (f"<{S}where>", r'"{ ?x <http://e/name> ?n . ?x (<http://e/KEY> / (<http://e/q>*)) ?o . OPTIONAL { ?x <http://e/p> 5 } . FILTER(((?n != \\\"z\\\") && (STRLEN(?n) > 3))) }"'),
    (f"<{S}group-by>", '"?n"'), (f"<{S}having>", '"(COUNT(?o) > KEY)"'), (f"<{S}order-by>", '"DESC ?n"'), (f"<{S}limit>", '"7"'),
)
encoded(
    "encode_sparql_update", "sparql", "INSERT DATA { <http://e/KEY> <http://e/p> 'NAME' } ; CLEAR SILENT GRAPH <http://e/g> ; WITH <http://e/w> DELETE { ?x <http://e/p> ?y } INSERT { ?x <http://e/q> ?y } WHERE { ?x <http://e/p> ?y }",
    f"<{S}request>",
    (f"<{S}kind>", '"update"'), (f"<{S}op>", '"INSERT_DATA"'), (f"<{S}insert-data>", r'"{ <http://e/KEY> <http://e/p> \\\"NAME\\\" }"'), (f"<{S}op>", '"CLEAR SILENT GRAPH <http://e/g>"'),
    (f"<{S}op>", '"MODIFY"'), (f"<{S}modify-with>", '"http://e/w"'), (f"<{S}modify-delete>", '"{ ?x <http://e/p> ?y }"'), (f"<{S}modify-insert>", '"{ ?x <http://e/q> ?y }"'), (f"<{S}modify-where>", '"{ ?x <http://e/p> ?y }"'),
)


@register("SELECT page_id, page_id % 2 = 0 AS accepted, CASE page_id % 2 WHEN 0 THEN '<HTTP://e/./' || page_id || '>' END AS s, CASE page_id % 2 WHEN 0 THEN '<urn:x-rdf-iri:parses-to>' END AS p, CASE page_id % 2 WHEN 0 THEN '<http://e/' || page_id || '>' END AS o FROM pages")
def encode_iri(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("HTTP://e/./"), F.col("page_id").cast("string"))).otherwise(F.when(F.col("page_id") % 4 == 1, "../x").otherwise("http://e/a b")).alias("content"))
    f = F.try_element_at("facts", F.lit(1))
    return reader.parse_iris(docs).select(F.col("path").cast("long").alias("page_id"), "accepted", f["s"].alias("s"), f["p"].alias("p"), f["o"].alias("o"))


@register("SELECT c_custkey AS k, CAST(2 AS BIGINT) AS n, true AS same FROM customer")
def encode_datalog(spark, sf_dir):
    """A fact for each clause, the same whatever stands between the words."""
    one, two = told("p(KEY). q(X) :- p(X), not r(X)."), told("p( KEY ) .\n% no more\nq(X):-p(X),\n not r(X).")
    docs = lambda c: table(spark, sf_dir, "customer").select(K().alias("path"), F.lit("datalog").alias("lang"), c.alias("content"))
    found = lambda c: reader.facts_of(reader.parse(docs(c))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.concat("p", "o"))).alias("all"))
    a, b = found(one), found(two)
    return a.join(b.select("doc_id", F.col("all").alias("other")), "doc_id").select(F.col("doc_id").cast("long").alias("k"), F.least(F.col("n"), F.lit(2).cast("long")).alias("n"), (F.col("all") == F.col("other")).alias("same"))


@register("SELECT c_custkey AS k, true AS accepted, true AS some FROM customer")
def encode_shex(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(K().alias("path"), F.lit("shex").alias("lang"), told("PREFIX e: <http://e/> <http://e/S> CLOSED EXTRA e:p { e:p IRI {KEY,} ; e:q [ 1 2 ] ? }").alias("content"))
    return reader.parse(docs).select(F.col("path").cast("long").alias("k"), "accepted", (F.size("facts") > 0).alias("some"))


@register("SELECT 'iri-parser' AS parser, 'c' || c_custkey AS id, c_custkey % 2 = 0 AS accepted, CAST(c_custkey AS BIGINT) AS fact_count FROM customer")
def oracle_corpus(spark, sf_dir):
    """A corpus of expected results, written as JSON and read back."""
    c = table(spark, sf_dir, "customer")
    case = F.struct(F.concat(F.lit("c"), K()).alias("id"), F.lit("x.nt").alias("input_path"), (F.col("c_custkey") % 2 == 0).alias("accepted"), F.array(F.lit("<a:a> <a:a> <a:a> .")).alias("facts"), F.col("c_custkey").alias("fact_count"))
    path = new_folder(spark, "oracles")
    c.groupBy(F.floor(F.col("c_custkey") / 100).alias("part")).agg(F.collect_list(case).alias("cases")).select(F.lit("1").alias("schema_version"), F.lit("nt").alias("lang"), F.lit("iri-parser").alias("parser"), "cases", "part").repartition("part").write.mode("append").partitionBy("part").option("maxRecordsPerFile", 1).json(path)
    return reader.read_oracle(spark, path).select("parser", "id", "accepted", "fact_count")


def line_corpus(spark, sf_dir) -> str:
    """A folder of N-Triples files, one for each nation, of the names and the segments of its customers."""
    lines = F.explode(F.array(F.concat(F.lit("<urn:c:"), K(), F.lit("> <urn:name> "), T.string(F.concat("c_name", F.lit(" é😀"))), F.lit(" .")), F.concat(F.lit("# "), F.col("c_mktsegment")), F.concat(F.lit("<urn:c:"), K(), F.lit(">  <urn:segment>  "), T.string(F.col("c_mktsegment")), F.lit("."))))
    path = new_folder(spark, "lines")
    table(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", lines.alias("value")).write.mode("append").partitionBy("c_nationkey").text(path)
    return path


#: The lines of line_corpus, n counting those of a customer; each has one byte for its end.
LINES = "WITH l AS (SELECT c_nationkey AS nation, c_custkey AS k, n, CASE n WHEN 0 THEN '<urn:c:' || c_custkey || '> <urn:name> \"' || c_name || ' é😀\" .' WHEN 1 THEN '# ' || c_mktsegment ELSE '<urn:c:' || c_custkey || '>  <urn:segment>  \"' || c_mktsegment || '\".' END AS line FROM customer, (VALUES (0), (1), (2)) v(n)), p AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY nation ORDER BY k, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS src_offset FROM l) "


@register(LINES + "SELECT CAST(nation AS BIGINT) AS nation, '<urn:c:' || k || '>' AS s, CASE n WHEN 0 THEN 'urn:name' ELSE 'urn:segment' END AS p, src_offset FROM p WHERE n <> 1")
def nt_offsets(spark, sf_dir):
    """Each fact with the byte of its file that its line begins at."""
    facts = reader.read_lines(spark, line_corpus(spark, sf_dir))
    return facts.select(F.regexp_extract("doc_id", r"c_nationkey=(\d+)", 1).cast("long").alias("nation"), "s", T.iri_text(F.col("p")).alias("p"), "src_offset")


@register(LINES + "SELECT CAST(nation AS BIGINT) AS nation, count(*) AS lines, CAST(max(src_offset) AS BIGINT) AS last FROM p GROUP BY nation")
def nt_places(spark, sf_dir):
    """The splits of each file, and where the last line begins."""
    path = line_corpus(spark, sf_dir)
    places = reader.line_places(spark, path)
    last = reader.read_lines(spark, path, places=places).groupBy("doc_id").agg(F.max("src_offset").alias("last"))
    return reader.line_files(places).join(last, "doc_id").select(F.regexp_extract("doc_id", r"c_nationkey=(\d+)", 1).cast("long").alias("nation"), "lines", "last")


# -- facts
@register("SELECT '<urn:c:' || c_custkey || '>' AS s, '\"' || c_name || '\"' AS o FROM customer UNION ALL SELECT '<urn:c:' || c_custkey || '>', '\"x\"@en-US' FROM customer")
def facts_canonicalise(spark, sf_dir):
    """Tags, xsd:string and repeated facts in one go."""
    c = table(spark, sf_dir, "customer")
    s = F.concat(F.lit("<urn:c:"), K(), F.lit(">"))
    terms = F.array(T.string(F.col("c_name")), F.concat(T.string(F.col("c_name")), F.lit(f"^^<{XSD}string>")), F.lit('"x"@EN-us'), F.lit('"x"@en-US'))
    facts = c.select(F.lit("d").alias("doc_id"), s.alias("s"), F.lit("<urn:p>").alias("p"), F.posexplode(terms).alias("src_offset", "o"), F.lit(None).cast("string").alias("g"), F.lit("t").alias("parser"))
    return O.canonicalise(facts).select("s", "o")


def parts_of_sizes(spark, sf_dir, n: int) -> DataFrame:
    """The parts of each size as the objects of one key, of which each version lacks some or has others."""
    k, size = F.col("p_partkey"), F.col("p_size") % 6
    known = {0: F.lit(True), 1: F.lit(n < 3), 2: F.lit(n > 0) | (k % 9 != 0), 3: k % 9 != n, 4: F.lit(n != 1)}
    held = F.lit(True)
    for number, test in known.items():
        held = F.when(size == number, test).otherwise(held)
    term = lambda kind, c: F.concat(F.lit(f"<urn:{kind}:"), c.cast("string"), F.lit(">"))
    return table(spark, sf_dir, "part").where(held).select(term("size", size).alias("s"), F.lit("<urn:part>").alias("p"), term("part", k).alias("o"), F.lit(None).cast("string").alias("g"))


@register("""WITH k AS (SELECT p_partkey AS k, p_size % 6 AS size FROM part),
h AS (SELECT n, size, k FROM k, (VALUES (0), (1), (2), (3)) v(n) WHERE CASE size WHEN 1 THEN n < 3 WHEN 2 THEN n > 0 OR k % 9 <> 0 WHEN 3 THEN k % 9 <> n WHEN 4 THEN n <> 1 ELSE true END),
t AS (SELECT n, size, list(k ORDER BY k) AS own FROM h GROUP BY n, size),
a AS (SELECT s.size, v.n, own FROM (SELECT DISTINCT size FROM k) s CROSS JOIN (VALUES (0), (1), (2), (3)) v(n) LEFT JOIN t ON t.size = s.size AND t.n = v.n),
c AS (SELECT x.size, x.n, x.own, (SELECT count(*) FROM a y WHERE y.size = x.size AND y.own IS NOT DISTINCT FROM x.own) AS alike FROM a x)
SELECT CASE WHEN own IS NULL THEN 'FactOnlyIn' ELSE 'ObjectMismatch' END AS kind, CAST(size AS BIGINT) AS size, 'v' || n AS parser_id, unnest(coalesce(own, [0])) AS part FROM c WHERE 2 * alike <= 4""")
def diff_many_sets(spark, sf_dir):
    """Four versions of keys with a sixth of all parts each: sets are compared by fingerprints and never gathered."""
    told = O.diff_many({f"v{n}": parts_of_sizes(spark, sf_dir, n) for n in range(4)})
    number = lambda c: F.coalesce(F.regexp_extract(c, r"(\d+)>", 1).try_cast("long"), F.lit(0).cast("long"))
    return told.select("kind", number("s").alias("size"), "parser_id", number("o").alias("part"))


@register("SELECT lang, CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id % 5 <> 0")
def facts_allowed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("name"), F.lit(False).alias("pass"))
    return O.allowed(d.drop("doc_id"), d.where("doc_id % 5 = 0").select("lang", "name")).select("lang", "name")


@register("""SELECT lang, CAST(count(*) AS BIGINT) AS tests, CAST(count(*) FILTER (WHERE doc_id % 7 = 0) AS BIGINT) AS divergences, CAST(count(*) FILTER (WHERE doc_id % 11 = 0) AS BIGINT) AS skipped,
count(*) FILTER (WHERE doc_id % 7 = 0) = 0 AS clean, CAST(count(*) AS BIGINT) AS entries, 1 AS corpora FROM documents WHERE doc_id % 77 <> 0 GROUP BY lang""")
def report_of_languages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 77 <> 0")
    bad, skip = F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0
    verdicts = d.select("lang", F.col("doc_id").cast("string").alias("name"), F.lit("Eval").alias("kind"), (~bad & ~skip).alias("pass"), F.when(bad, "FactOnlyIn").alias("divergence"), F.lit("m").alias("message"), skip.alias("skipped"))
    inputs = d.select("lang", F.lit("corpus").alias("role"), F.concat(F.lit("/c/"), "lang").alias("path")).distinct()
    made = reader.reports(verdicts, inputs)
    got = F.from_json("report", "tests_executed bigint, divergences bigint, skipped bigint, clean boolean, entries array<struct<name:string>>, corpora_count int")
    return made.select("lang", got.alias("r")).select("lang", F.col("r.tests_executed").alias("tests"), "r.divergences", "r.skipped", "r.clean", F.size("r.entries").cast("long").alias("entries"), F.col("r.corpora_count").alias("corpora"))


@register("SELECT CAST(count(DISTINCT lang) AS BIGINT) AS languages, CAST(count(*) FILTER (WHERE doc_id % 7 = 0) AS BIGINT) AS divergences, count(*) FILTER (WHERE doc_id % 7 = 0) > 0 AS failed FROM documents")
def report_summary(spark, sf_dir):
    bad = F.col("doc_id") % 7 == 0
    verdicts = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("name"), F.lit("Eval").alias("kind"), (~bad).alias("pass"), F.when(bad, "ObjectMismatch").alias("divergence"), F.lit("").alias("message"))
    got = F.from_json("summary", "languages_checked bigint, total_divergences bigint, had_unacceptable_failure boolean")
    return reader.summary(reader.reports(verdicts)).select(got.alias("r")).select(F.col("r.languages_checked").alias("languages"), F.col("r.total_divergences").alias("divergences"), F.col("r.had_unacceptable_failure").alias("failed"))


# -- sinks
@register("SELECT doc_id, '<http://e/a%20b>' AS iri, length(text) AS n FROM documents")
def sink_escapes(spark, sf_dir):
    """A term written as a line keeps its characters; what an IRI can't hold is escaped."""
    d = table(spark, sf_dir, "documents")
    facts = d.select(F.lit("<http://e/a%20b>").alias("s"), F.concat(F.lit("<urn:p:"), F.col("doc_id").cast("string"), F.lit(">")).alias("p"), T.string(F.col("text")).alias("o"))
    docs = sinks.ntriples(facts).select(F.lit("nt").alias("lang"), F.xxhash64("value").cast("string").alias("path"), F.col("value").alias("content"))
    out = reader.facts_of(reader.parse(docs), canonical=False)
    return out.select(F.regexp_extract("p", r"(\d+)>$", 1).cast("long").alias("doc_id"), F.col("s").alias("iri"), F.length(T.lexical(F.col("o"))).cast("long").alias("n"))


@register("SELECT CAST(count(*) AS BIGINT) AS n, true AS same FROM customer")
def sink_format(spark, sf_dir):
    """A document formatted, and formatted once more: nothing changes."""
    docs = table(spark, sf_dir, "customer").select(F.concat(K(), F.lit(".ttl")).alias("path"), told('@prefix e: <http://e/> .\n<http://e/b>   e:p "NAME", KEY ; a e:C.').alias("content"))

    def formatted(docs: DataFrame) -> DataFrame:
        return sinks.formatted(reader.facts_of(reader.parse(docs)), "ttl", {"e": "http://e/"}).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))

    once = formatted(docs)
    twice = formatted(once).withColumnRenamed("content", "again")
    return once.join(twice, "path").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("content") == F.col("again")).alias("same"))


# -- SPARQL: what the others leave out
ask("sparql_bound", "SELECT ?n ?b WHERE { ?c <urn:t:c_name> ?n OPTIONAL { ?o <urn:t:o_custkey> ?c } BIND(BOUND(?o) AS ?b) }", "customer orders", "SELECT c_name AS n, o_orderkey IS NOT NULL AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey", n="text", b="bool")
ask("sparql_ebv", "SELECT ?k WHERE { ?x <urn:t:c_custkey> ?k ; <urn:t:c_name> ?n BIND(?k - 3 AS ?m) BIND(IF(?k > 5, ?n, '') AS ?t) FILTER((?m && ?t) || !?m) }", "customer", "SELECT c_custkey AS k FROM customer WHERE c_custkey - 3 <> 0 AND c_custkey > 5 OR c_custkey = 3", k="long")
ask("sparql_uri_isuri", "SELECT ?k (ISURI(URI(CONCAT('http://e/', ?n))) AS ?i) (ISURI(?n) AS ?j) (STR(URI(CONCAT('http://e/', ?n))) AS ?s) WHERE { ?x <urn:t:n_name> ?n ; <urn:t:n_nationkey> ?k }", "nation", "SELECT n_nationkey AS k, true AS i, false AS j, 'http://e/' || n_name AS s FROM nation", k="long", i="bool", j="bool", s="text")
ask("sparql_timezone", f"PREFIX xsd: <{XSD}> SELECT ?k (STR(TIMEZONE(STRDT(CONCAT('2020-01-02T03:04:05', ?z), xsd:dateTime))) AS ?t) WHERE {{ ?x <urn:t:n_nationkey> ?k BIND(IF(?k > 20, 'Z', IF(?k > 10, '-08:30', '+02:00')) AS ?z) }}", "nation", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 20 THEN 'PT0S' WHEN n_nationkey > 10 THEN '-PT8H30M' ELSE 'PT2H' END AS t FROM nation", k="long", t="text")
ask("sparql_hash_digests", "SELECT ?n (SHA512(?n) AS ?a) (SHA384(?n) AS ?b) WHERE { ?x <urn:t:r_name> ?n }", "region", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{hashlib.sha512(n.encode()).hexdigest()}', '{hashlib.sha384(n.encode()).hexdigest()}')" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + ") v(n, a, b) WHERE n IN (SELECT r_name FROM region)", n="text", a="text", b="text")
ask("sparql_lists_and_bnodes", "SELECT ?n ?r WHERE { [ <urn:t:n_name> ?n ; <urn:t:n_regionkey> [ <urn:t:r_name> ?r ] ] }", "nation region", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey", n="text", r="text")
ask("sparql_path_precedence", "SELECT ?x ?y WHERE { ?x ^<urn:t:n_regionkey>|<urn:t:n_regionkey>/<urn:t:r_name> ?y }", "nation region", "SELECT 'urn:t:region:' || n_regionkey AS x, '<urn:t:nation:' || n_nationkey || '>' AS y FROM nation UNION ALL SELECT 'urn:t:nation:' || n_nationkey, '\"' || r_name || '\"' FROM nation JOIN region ON n_regionkey = r_regionkey", x="iri", y="term")
ask("sparql_agg_mixed", "SELECT ?g (SUM(?v) AS ?t) (AVG(?v) AS ?a) (COUNT(?v) AS ?n) WHERE { ?c <urn:t:c_custkey> ?k ; <urn:t:c_name> ?x BIND(?k / 5 - FLOOR(?k / 5) AS ?f) BIND(IF(?f = 0, 'error', IF(?f < 0.5, 'low', 'high')) AS ?g) BIND(IF(?f = 0 && ?k / 2 = FLOOR(?k / 2), ?x, ?k) AS ?v) } GROUP BY ?g", "customer", "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'error' WHEN c_custkey % 5 < 3 THEN 'low' ELSE 'high' END AS g, CASE WHEN min(c_custkey % 5) > 0 THEN CAST(sum(c_custkey) AS BIGINT) END AS t, CASE WHEN min(c_custkey % 5) > 0 THEN avg(c_custkey) END AS a, count(*) AS n FROM customer GROUP BY 1", g="text", t="long", a="double", n="long")
ask("sparql_having_error", "SELECT ?g WHERE { ?c <urn:t:c_custkey> ?k ; <urn:t:c_name> ?x BIND(?k / 5 - FLOOR(?k / 5) AS ?g) BIND(IF(?g = 0 && ?k / 2 = FLOOR(?k / 2), ?x, ?k) AS ?v) } GROUP BY ?g HAVING (SUM(?v) > 2)", "customer", "SELECT (c_custkey % 5) / 5 AS g FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1 HAVING sum(c_custkey) > 2", g="double")
ask("sparql_exists_correlated", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n ; <urn:t:c_acctbal> ?b FILTER(?b > 9000 || EXISTS { ?o <urn:t:o_custkey> ?c ; <urn:t:o_totalprice> ?p FILTER(?p > ?b * 100) }) }", "customer orders", "SELECT c_name AS n FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 100)", n="text")
ask("sparql_exists_duplicates", "SELECT ?m ?z WHERE { ?c <urn:t:c_mktsegment> ?m OPTIONAL { ?c <urn:none> ?z } FILTER(?m = 'x' || EXISTS { ?d <urn:t:c_mktsegment> ?m ; <urn:t:c_acctbal> ?b FILTER(?b > 0) }) }", "customer", "SELECT c_mktsegment AS m, CAST(NULL AS VARCHAR) AS z FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 0)", m="text", z="text")
ask("sparql_loose_join", "SELECT ?n ?k ?t WHERE { ?c <urn:t:c_name> ?n ; <urn:t:c_custkey> ?q OPTIONAL { ?o <urn:t:o_custkey> ?c ; <urn:t:o_orderkey> ?k } { SELECT (?j AS ?k) ?t WHERE { ?x <urn:t:o_orderkey> ?j ; <urn:t:o_orderstatus> ?t FILTER(?j < 20) } } FILTER(?q < 40) }", "customer orders", "SELECT c_name AS n, b.o_orderkey AS k, b.o_orderstatus AS t FROM customer LEFT JOIN orders a ON a.o_custkey = c_custkey JOIN orders b ON b.o_orderkey = a.o_orderkey OR a.o_orderkey IS NULL WHERE b.o_orderkey < 20 AND c_custkey < 40", n="text", k="long", t="text")
ask("sparql_regex_errors", "SELECT ?n (COALESCE(REPLACE(?n, 'o', 'a$b'), 'error') AS ?a) (COALESCE(REGEX(?n, '['), 'error') AS ?b) (REPLACE(?n, '(N)', '<$1>') AS ?c) WHERE { ?x <urn:t:n_name> ?n }", "nation", "SELECT n_name AS n, 'error' AS a, 'error' AS b, replace(n_name, 'N', '<N>') AS c FROM nation", n="text", a="text", b="text", c="text")
ask("sparql_long_integers", "SELECT ?k (STR(?k * 1000000000000000000000000 + 1) AS ?v) WHERE { ?x <urn:t:n_nationkey> ?k FILTER(?k > 0) }", "nation", "SELECT n_nationkey AS k, n_nationkey || '000000000000000000000001' AS v FROM nation WHERE n_nationkey > 0", k="long", v="text")


@register("SELECT '<urn:x:' || n_nationkey || '>' AS s, '<urn:p>' AS p, '\"' || n_name || '\"' AS o, '<urn:loaded>' AS g FROM nation UNION ALL " + BASE_SQL)
def sparql_update_load(spark, sf_dir):
    """LOAD from a source that is told; one that fails in silence."""
    n = table(spark, sf_dir, "nation")
    facts = n.select(F.concat(F.lit("<urn:n:"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:name>").alias("p"), T.string(F.col("n_name")).alias("o"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("<urn:r:"), F.col("n_regionkey").cast("string"), F.lit(">"))).alias("g"))

    def load(iri: str) -> DataFrame:
        if iri != "urn:source":
            raise ValueError(iri)
        return n.select(F.concat(F.lit("<urn:x:"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:p>").alias("p"), T.string(F.col("n_name")).alias("o"))

    return update(spark, facts, "LOAD <urn:source> INTO GRAPH <urn:loaded> ; LOAD SILENT <urn:none>", load)


@register("SELECT '<urn:n:' || n_nationkey || '>' AS s, '<urn:title>' AS p, '\"' || n_name || '\"' AS o, CAST(NULL AS VARCHAR) AS g FROM nation WHERE n_regionkey = 1 UNION ALL " + BASE_SQL)
def sparql_update_using(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    facts = n.select(F.concat(F.lit("<urn:n:"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:name>").alias("p"), T.string(F.col("n_name")).alias("o"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("<urn:r:"), F.col("n_regionkey").cast("string"), F.lit(">"))).alias("g"))
    return update(spark, facts, "INSERT { ?x <urn:title> ?n } USING <urn:r:1> WHERE { ?x <urn:name> ?n }")


# -- SPARQL: solutions that are equal stay several, and blank nodes are each solution's own
def nodes_told(df: DataFrame, *by: str) -> DataFrame:
    """The blank nodes in s as numbers from 1 among those with the same values: SQL knows no labels."""
    return df.withColumn("node", F.dense_rank().over(Window.partitionBy(*by).orderBy("s")).cast("long"))


@register("SELECT segment, node, p FROM (SELECT c_mktsegment AS segment, row_number() OVER (PARTITION BY c_mktsegment) AS node FROM customer), (VALUES ('urn:of'), ('urn:again')) v(p)")
def sparql_construct_solutions(spark, sf_dir):
    """Customers of one segment are equal solutions; each makes a node, which both of its triples have."""
    made = sparql(spark, mapped(spark, sf_dir, "customer"), "CONSTRUCT { _:x <urn:of> ?m ; <urn:again> ?m } WHERE { SELECT ?m WHERE { ?c <urn:t:c_mktsegment> ?m } }")
    return nodes_told(made, "o").select(T.lexical(F.col("o")).alias("segment"), "node", T.iri_text(F.col("p")).alias("p"))


@register("SELECT a.n_name AS a, b.n_name AS b, a.n_regionkey = b.n_regionkey AS same, a.n_regionkey = b.n_regionkey AS joined, CAST(1 + CAST(a.n_regionkey = b.n_regionkey AS INT) AS BIGINT) AS shared FROM nation a, nation b WHERE a.n_nationkey % 5 = b.n_nationkey % 5")
def sparql_bnode_solution(spark, sf_dir):
    """One node for one text within a solution, before and after a join, and no node in two solutions."""
    nations = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("<urn:n:"), F.col("n_nationkey").cast("string"), F.lit(">"))
    more = nations.select(name.alias("s"), F.lit("<urn:mod>").alias("p"), T.typed((F.col("n_nationkey") % 5).cast("string"), "integer").alias("o")).union(nations.select(name, F.lit("<urn:name>"), T.string(F.col("n_name")))).union(nations.select(name, F.lit("<urn:region>"), T.string(F.col("n_regionkey").cast("string"))))
    facts = Facts(more.withColumn("g", F.lit(None).cast("string")))
    text = "SELECT ?a ?b (BNODE(?q) AS ?y) ?x (SAMETERM(?x, ?z) AS ?joined) (SAMETERM(?x, ?y) AS ?same) WHERE { ?m <urn:mod> ?k ; <urn:region> ?r . ?n <urn:mod> ?k ; <urn:region> ?q BIND(BNODE(?r) AS ?x) ?m <urn:name> ?a . ?n <urn:name> ?b BIND(BNODE(?q) AS ?z) }"
    got = sparql(spark, facts, text)
    uses = got.select(F.explode(F.array("x", "y")).alias("x")).groupBy("x").count()
    met = got.join(uses, "x")
    return met.select(T.lexical(F.col("a")).alias("a"), T.lexical(F.col("b")).alias("b"), T.to_boolean(F.col("same")).alias("same"), T.to_boolean(F.col("joined")).alias("joined"), F.col("count").alias("shared"))


@register("SELECT 'urn:r:' || n_regionkey AS g, n_name AS name, row_number() OVER (PARTITION BY n_regionkey, n_name) AS node FROM nation UNION ALL SELECT NULL, 'two', n FROM (VALUES (1), (2)) v(n)")
def sparql_update_bnodes(spark, sf_dir):
    """Each solution's insertion has a node of its own, and so has each operation."""
    n = table(spark, sf_dir, "nation")
    facts = n.select(F.concat(F.lit("<urn:n:"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:name>").alias("p"), T.string(F.col("n_name")).alias("o"), F.concat(F.lit("<urn:r:"), F.col("n_regionkey").cast("string"), F.lit(">")).alias("g"))
    done = update(spark, facts, "INSERT { GRAPH ?g { _:x <urn:seen> ?name } } WHERE { GRAPH ?g { _:x <urn:name> ?name } } ; INSERT DATA { _:a <urn:seen> 'two' } ; INSERT DATA { _:b <urn:seen> 'two' }").where("p = '<urn:seen>'")
    return nodes_told(done, "g", "o").select(T.iri_text(F.col("g")).alias("g"), T.lexical(F.col("o")).alias("name"), "node")


def many_operations() -> str:
    """Two hundred operations that depend on each other: data, changes by pattern, copied and cleared graphs."""
    out = []
    for i in range(40):
        out += [
            f"INSERT DATA {{ GRAPH <urn:w> {{ <urn:x:{i}> <urn:n> {i} }} }}", f"DELETE DATA {{ GRAPH <urn:w> {{ <urn:x:{i - 3}> <urn:n> {i - 3} }} }}", f"INSERT DATA {{ GRAPH <urn:w> {{ <urn:x:{i}> <urn:n> {i % 4} }} }}",
            f"WITH <urn:r:{i % 5}> DELETE {{ ?x <urn:name> ?n }} INSERT {{ ?x <urn:name> ?n ; <urn:step> {i} }} WHERE {{ ?x <urn:name> ?n }}" if i % 8 == 3 else f"INSERT DATA {{ <urn:y> <urn:n> {i % 6} }}",
            "ADD SILENT <urn:w> TO <urn:v>" if i == 20 else "CLEAR SILENT GRAPH <urn:v>" if i == 10 else "COPY DEFAULT TO <urn:d>" if i == 30 else f"DELETE DATA {{ <urn:y> <urn:n> {i % 7} }}",
        ]
    return " ;\n".join(out)


def operations_sql() -> str:
    """The facts after many_operations, by folding the requests' own data here and the rows of nations in SQL."""
    w, y, copied, v = {}, {}, {}, set()
    steps: dict[int, list[int]] = {}
    for i in range(40):
        w[i, i] = True
        w.pop((i - 3, i - 3), None)
        w[i, i % 4] = True
        if i % 8 == 3:
            steps.setdefault(i % 5, []).append(i)
        else:
            y[i % 6] = True
        if i == 20:
            v |= set(w)
        elif i == 30:
            copied = dict(y)
        elif i != 10:
            y.pop(i % 7, None)
    told = [(f"<urn:x:{a}>", b, "<urn:w>") for a, b in w] + [(f"<urn:x:{a}>", b, "<urn:v>") for a, b in v] + [("<urn:y>", b, None) for b in y] + [("<urn:y>", b, "<urn:d>") for b in copied]
    number = lambda n: f"'\"{n}\"{INTEGER}'"
    rows = [f"SELECT '{s}' AS s, '<urn:n>' AS p, {number(o)} AS o, {repr(g) if g else 'CAST(NULL AS VARCHAR)'} AS g" for s, o, g in told]
    # Nations of region 0 are in the default graph, so no graph <urn:r:0> is there; that graph was copied once.
    rows += [f"SELECT '<urn:n:' || n_nationkey || '>', '<urn:step>', {number(i)}, '<urn:r:' || n_regionkey || '>' FROM nation WHERE n_regionkey = {r}" for r, own in steps.items() if r for i in own]
    rows += ["SELECT '<urn:n:' || n_nationkey || '>', '<urn:name>', '\"' || n_name || '\"', '<urn:d>' FROM nation WHERE n_regionkey = 0", BASE_SQL]
    return " UNION ALL ".join(rows)


@register(operations_sql())
def sparql_update_sequence(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    graph = F.when(F.col("n_regionkey") > 0, F.concat(F.lit("<urn:r:"), F.col("n_regionkey").cast("string"), F.lit(">")))
    facts = n.select(F.concat(F.lit("<urn:n:"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:name>").alias("p"), T.string(F.col("n_name")).alias("o"), graph.alias("g"))
    return update(spark, facts, many_operations())


def long_numbers(spark, sf_dir) -> Facts:
    """A number of each order that no double tells from its neighbours: integers of 41 digits, below zero too, and decimals of 30 places."""
    k = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    kind = F.col("o_orderkey") % 4
    value = F.when(kind == 0, T.typed(F.concat(F.lit("90071992547409930000000000000"), k), "integer")).when(kind == 1, T.typed(F.concat(F.lit("-90071992547409930000000000000"), k), "integer"))
    value = value.when(kind == 2, T.typed(F.concat(F.lit("0.100000000000000000"), k), "decimal")).otherwise(T.typed(F.concat(F.lit("-00.100000000000000000"), k, F.lit("0")), "decimal"))
    subject = F.concat(F.lit("<urn:o:"), F.col("o_orderkey").cast("string"), F.lit(">"))
    pairs = F.explode(F.array(F.struct(F.lit("<urn:v>").alias("p"), value.alias("o")), F.struct(F.lit("<urn:c>").alias("p"), T.typed((F.col("o_custkey") % 7).cast("string"), "integer").alias("o"))))
    return Facts(table(spark, sf_dir, "orders").select(subject.alias("s"), pairs.alias("x"), F.lit(None).cast("string").alias("g")).select("s", "x.p", "x.o", "g"))


#: Orders with where their number stands: its kind from the least to the largest, and its place within the kind.
PLACED = "WITH n AS (SELECT o_orderkey AS k, o_custkey % 7 AS c, CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS kind, CASE WHEN o_orderkey % 4 IN (1, 3) THEN -o_orderkey ELSE o_orderkey END AS place FROM orders) "


@register(PLACED + "SELECT CAST(c AS BIGINT) AS c, arg_min(k, (kind, place)) AS lo, arg_max(k, (kind, place)) AS hi FROM n GROUP BY c")
def sparql_minmax_exact(spark, sf_dir):
    """The least and the largest of numbers beyond doubles, told by the order that they belong to."""
    got = sparql(spark, long_numbers(spark, sf_dir), "SELECT ?c (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) WHERE { ?o <urn:v> ?v ; <urn:c> ?c } GROUP BY ?c")
    key = lambda c: F.regexp_extract(F.rpad(F.when(F.col(c).rlike("^\"-00"), F.regexp_replace(c, '0"', '"')).otherwise(F.col(c)), 400, " "), r'(\d{12})"', 1).cast("long").alias(c)
    return got.select(T.raw_lexical(F.col("c")).cast("long").alias("c"), key("lo"), key("hi"))


@register(PLACED + "SELECT k, r FROM (SELECT k, row_number() OVER (ORDER BY kind, place) AS r FROM n) WHERE r BETWEEN 4 AND 53")
def sparql_order_exact(spark, sf_dir):
    """The 4th to the 53rd of numbers beyond doubles, each with its place."""
    got = sparql(spark, long_numbers(spark, sf_dir), "SELECT ?o ?v WHERE { ?o <urn:v> ?v } ORDER BY ?v OFFSET 3 LIMIT 50")
    place = F.row_number().over(Window.orderBy(T.order_key(F.col("v")))) + 3
    return got.select(F.regexp_extract("o", r"(\d+)>", 1).cast("long").alias("k"), place.cast("long").alias("r"))


ask("sparql_group_concat_terms", "SELECT ?r (GROUP_CONCAT(DISTINCT ?t; SEPARATOR='|') AS ?v) (COUNT(DISTINCT ?t) AS ?c) WHERE { ?n <urn:t:n_regionkey> ?r ; <urn:t:n_nationkey> ?k BIND(STRLANG(IF(?k > 20, 'y', 'x'), IF(?k > 12, 'en', 'fr')) AS ?t) }  GROUP BY ?r", "nation",
    "SELECT 'urn:t:region:' || n_regionkey AS r, string_agg(t, '|' ORDER BY t) AS v, count(*) AS c FROM (SELECT DISTINCT n_regionkey, CASE WHEN n_nationkey > 20 THEN 'y' ELSE 'x' END AS t, n_nationkey > 12 AS l FROM nation) GROUP BY 1", r="iri", v="text", c="long")


def order_stars(spark, sf_dir) -> Stars:
    """Facts of orders, of which some have an urgent mark and most have several parts, laid out by characteristic sets."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    subject = lambda c: F.concat(F.lit("<urn:o:"), F.col(c).cast("string"), F.lit(">"))
    fields = {"key": T.typed(F.col("o_orderkey").cast("string"), "integer"), "status": T.string(F.col("o_orderstatus")), "priority": T.string(F.col("o_orderpriority")), "cust": T.typed(F.col("o_custkey").cast("string"), "integer"), "urgent": F.when(F.startswith("o_orderpriority", F.lit("1")), F.lit('"yes"'))}
    pairs = F.explode(F.array(*(F.struct(F.lit(f"<urn:{k}>").alias("p"), v.alias("o")) for k, v in fields.items())))
    one = o.select(subject("o_orderkey").alias("s"), pairs.alias("x")).select("s", "x.p", "x.o").where("o IS NOT NULL")
    many = line.select(subject("l_orderkey").alias("s"), F.lit("<urn:part>").alias("p"), T.typed(F.col("l_partkey").cast("string"), "integer").alias("o"))
    return Stars.of(one.union(many).withColumn("g", F.lit(None).cast("string")))


@register("SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_custkey AS c, l_partkey AS i FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def sparql_star_facts(spark, sf_dir):
    """Five patterns of one subject over a table of facts, one of them with several values: a scan of each table that has them."""
    found = sparql(spark, order_stars(spark, sf_dir), "SELECT ?k ?s ?p ?c ?i WHERE { ?o <urn:key> ?k ; <urn:status> ?s ; <urn:priority> ?p ; <urn:cust> ?c ; <urn:part> ?i }")
    return decoded(found, k="long", s="text", p="text", c="long", i="long")


@register("SELECT o_orderkey AS k, c_n AS n FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS c_n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'")
def sparql_star_optional(spark, sf_dir):
    """A star that few subjects have, counted by subject."""
    found = sparql(spark, order_stars(spark, sf_dir), "SELECT ?k (COUNT(?i) AS ?n) WHERE { ?o <urn:key> ?k ; <urn:urgent> 'yes' ; <urn:part> ?i } GROUP BY ?k")
    return decoded(found, k="long", n="long")


# -- Datalog and ShEx
@register(RING + "SELECT CAST(a AS VARCHAR) AS c0 FROM r WHERE a = b")
def datalog_proposition(spark, sf_dir):
    """An atom without arguments, and a body in an order that would multiply tables."""
    return datalog(spark, "go(). reach(X, Y) :- next(X, Y). reach(X, Z) :- reach(X, Y), next(Y, Z). loop(X) :- node(X), go(), node(Y), reach(X, Y), same(X, Y). node(X) :- next(X, _). same(X, X) :- node(X).", {"next": ring(spark, sf_dir)}, "loop", 1)


def chained(spark, sf_dir) -> DataFrame:
    """Each customer and the next one by number, in chains of a hundred."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where((k + 1) % 100 != 0).select(k.cast("string").alias("c0"), (k + 1).cast("string").alias("c1"))


CHAINS = "SELECT CAST(a.c_custkey AS VARCHAR) AS c0, CAST(b.k AS VARCHAR) AS c1 FROM customer a JOIN (SELECT DISTINCT c_custkey + 1 AS k FROM customer WHERE (c_custkey + 1) % 100 <> 0) b ON a.c_custkey < b.k AND a.c_custkey // 100 = b.k // 100"


@register(CHAINS)
def datalog_chains(spark, sf_dir):
    """A recursion as deep as its chains are long, in rounds by the logarithm of that."""
    return datalog(spark, "after(X, Y) :- next(X, Y). after(X, Z) :- next(X, Y), after(Y, Z).", {"next": chained(spark, sf_dir)}, "after", 2)


@register(CHAINS)
def sparql_path_chains(spark, sf_dir):
    node = lambda c: F.concat(F.lit("<urn:"), F.col(c), F.lit(">"))
    facts = Facts(chained(spark, sf_dir).select(node("c0").alias("s"), F.lit("<urn:next>").alias("p"), node("c1").alias("o"), F.lit(None).cast("string").alias("g")))
    bare = lambda c: F.regexp_extract(c, r"(\d+)", 1)
    return sparql(spark, facts, "SELECT ?a ?b WHERE { ?a <urn:next>+ ?b }").select(bare("a").alias("c0"), bare("b").alias("c1"))


shex("shex_recursive", "<urn:S> { t:n_regionkey @<urn:R> } <urn:R> { ^t:n_regionkey @<urn:S> {5,} }", "SELECT 'urn:t:nation:' || n_nationkey AS node, (SELECT count(*) FROM nation m WHERE m.n_regionkey = n.n_regionkey) >= 5 AS conforms FROM nation n", "nation region", "nation")

C = "SELECT 'urn:t:customer:' || c_custkey AS node, {} AS conforms FROM customer"
shex("shex_extends", '<urn:S> EXTENDS @<urn:B> { t:c_nationkey IRI } ABSTRACT <urn:B> { t:c_mktsegment ["BUILDING"] }', C.format("c_mktsegment = 'BUILDING'"))
shex("shex_extra", "<urn:S> CLOSED EXTRA t:n_nationkey { t:n_name . ; t:n_regionkey [<urn:t:region:1>] }", "SELECT 'urn:t:nation:' || n_nationkey AS node, n_regionkey = 1 AS conforms FROM nation", "nation", "nation")


def ordered_facts(spark, sf_dir) -> DataFrame:
    """What priorities and states a customer's orders have, as facts of the customer."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f"<urn:t:{c}>").alias("p"), T.string(F.col(c)).alias("o")) for c in ("o_orderpriority", "o_orderstatus"))))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("<urn:t:customer:"), F.col("o_custkey").cast("string"), F.lit(">")).alias("s"), pairs.alias("x")).select("s", "x.p", "x.o").distinct()


def shex_of_orders(name: str, body: str, condition: str) -> None:
    """Registers a shape over customers with what their orders have; condition: of u, h, m, o (1-URGENT, 2-HIGH, 3-MEDIUM, others) and st (states), counts."""

    def run(spark, sf_dir):
        nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("<urn:t:customer:"), K(), F.lit(">")).alias("node"))
        return validate(ordered_facts(spark, sf_dir), nodes, f"PREFIX t: <urn:t:> <urn:S> {body}", "<urn:S>").select(T.iri_text(F.col("node")).alias("node"), "conforms")

    run.__name__ = name
    kinds = {"u": "= '1-URGENT'", "h": "= '2-HIGH'", "m": "= '3-MEDIUM'", "o": "> '4'"}
    counts = ", ".join(f"count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority {test}) AS {k}" for k, test in kinds.items())
    register(f"SELECT 'urn:t:customer:' || c_custkey AS node, {condition} AS conforms FROM (SELECT c_custkey, {counts}, count(DISTINCT o_orderstatus) AS st FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")(run)


# Each triple is one constraint's: some must go to the one that takes all, as others take them no more.
shex_of_orders("shex_matching", '{ t:o_orderpriority . ; t:o_orderpriority ["1-URGENT" "2-HIGH"] ; t:o_orderpriority ["2-HIGH" "3-MEDIUM"] ? }', "u + h + m + o BETWEEN 2 AND 3 AND o <= 1 AND u + h >= 1")
shex_of_orders("shex_matching_extra", 'EXTRA t:o_orderpriority { t:o_orderpriority ["1-URGENT"] ; t:o_orderpriority ["1-URGENT" "2-HIGH"] ; t:o_orderstatus . * }', "u = 1 AND h = 1")
shex_of_orders("shex_repeated_group", "{ ( t:o_orderstatus . ; t:o_orderpriority . {1,2} ){2} }", "st = 2 AND u + h + m + o BETWEEN 2 AND 4")
shex_of_orders("shex_repeated_choice", '{ ( t:o_orderpriority ["1-URGENT" "2-HIGH"] | t:o_orderstatus . ; t:o_orderpriority . ){3} }', "u + h + m + o = 3 AND st <= 3 AND m + o <= st")


# -- documents
def doc_tokens(lang: str, pattern: str, *expected: tuple) -> None:
    """Registers the tokens of one document a customer: line, start, length, type and modifiers, KEY being as long as the customer's number."""

    def sql() -> str:
        rows = ", ".join(f"({a}, {b}, {abs(n)}, {int(n < 0)}, {t}, {m})" for a, b, n, t, m in expected)
        return f"SELECT 'd' || c_custkey AS path, line, start, CAST(n + k * (length(c_custkey::VARCHAR) - 3) AS INT) AS length, type, modifiers FROM customer, (VALUES {rows}) v(line, start, n, k, type, modifiers)"

    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), K()).alias("path"), F.lit(lang).alias("lang"), told(pattern).alias("text"))
        return D.semantic_tokens(docs)

    run.__name__ = f"doc_tokens_{lang}"
    register(sql())(run)


# A length below zero is of what KEY stands in.
doc_tokens(
    "sparql", 'PREFIX e: <http://e/> # KEY\nselect ?x (COUNT(?y) AS ?n) WHERE { ?x a e:t , "a\\"é😀" , \'c d\' FILTER(?y >= 1.5e-3) } LIMIT KEY',
    (0, 0, 6, 6, 0), (0, 7, 2, 0, 0), (0, 10, 11, 2, 0), (0, 22, -5, 7, 0), (1, 0, 6, 6, 0), (1, 7, 2, 3, 0), (1, 11, 5, 6, 0), (1, 17, 2, 3, 0), (1, 21, 2, 6, 0), (1, 24, 2, 3, 0), (1, 28, 5, 6, 0),
    (1, 36, 2, 3, 0), (1, 39, 1, 2, 0), (1, 41, 3, 0, 0), (1, 47, 8, 4, 1), (1, 59, 1, 2, 0), (1, 61, 1, 2, 0), (1, 64, 6, 6, 0), (1, 71, 2, 3, 0), (1, 77, 6, 5, 0), (1, 87, 5, 6, 0), (1, 93, -3, 5, 0),
)
doc_tokens(
    "shex", 'PREFIX e: <http://e/> # KEY\ne:S CLOSED { e:p @e:T AND IRI {1,2} ; e:q-r [ "x" e:a~ ] } and BNODE\n<http://e/KEY',
    (0, 0, 6, 6, 0), (0, 7, 2, 0, 0), (0, 10, 11, 2, 0), (0, 22, -5, 7, 0), (1, 0, 3, 0, 0), (1, 4, 6, 6, 0), (1, 13, 3, 0, 0), (1, 17, 2, 6, 0), (1, 20, 1, 2, 0), (1, 22, 3, 6, 0), (1, 26, 3, 6, 0),
    (1, 38, 5, 0, 0), (1, 46, 3, 4, 1), (1, 50, 3, 0, 0), (1, 59, 3, 2, 0), (1, 63, 5, 6, 0), (2, 0, -13, 2, 0),
)
doc_tokens(
    "datalog", '  % KEY\np("a b", x1). q(X, Yy) :- p(X, _Z), not r(X). nothing(A) % KEY\n:- s(QKEY).',
    (0, 0, -7, 7, 0), (1, 0, 1, 2, 0), (1, 2, 5, 4, 1), (1, 9, 2, 2, 0), (1, 14, 1, 2, 0), (1, 16, 1, 3, 0), (1, 19, 2, 3, 0), (1, 26, 1, 2, 0), (1, 28, 1, 3, 0), (1, 32, 1, 3, 0), (1, 36, 3, 6, 0), (1, 40, 1, 2, 0), (1, 42, 1, 3, 0),
    (1, 46, 3, 6, 0), (1, 49, 4, 2, 0), (1, 54, 1, 3, 0), (1, 57, -5, 7, 0), (2, 3, 1, 2, 0), (2, 5, -4, 3, 0),
)
doc_tokens(
    "nt", "  # KEY\n<urn:a> <urn:b> \"x\\\"y\"@en . # KEY\n_:b1 <urn:b> 'z' . <urn:KEY",
    (0, 0, -7, 7, 0), (1, 0, 7, 2, 0), (1, 8, 7, 2, 0), (1, 16, 6, 4, 1), (1, 22, 3, 6, 0), (1, 28, -5, 7, 0), (2, 0, 4, 0, 0), (2, 5, 7, 2, 0), (2, 13, 3, 4, 1), (2, 19, -8, 2, 0),
)


@register("SELECT 'd' || c_custkey AS path, n, label, CASE WHEN n < 5 THEN 'keyword' ELSE 'value' END AS kind FROM customer, (VALUES (0, '@prefix'), (1, '@base'), (2, 'a'), (3, 'true'), (4, 'false'), (5, 'rdf:type'), (6, 'rdf:Property'), (7, 'rdf:List'), (8, 'rdf:nil'), (9, 'rdf:first'), (10, 'rdf:rest'), (11, 'rdf:value'), (12, 'rdf:Bag'), (13, 'rdf:Seq'), (14, 'rdf:Alt')) v(n, label)")
def doc_completions(spark, sf_dir):
    return D.completions(rdf_docs(spark, sf_dir)).select("path", "n", "label", "kind")


@register("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'foaf:x' || c_custkey END AS replacement, CASE WHEN c_custkey % 2 = 0 THEN '@prefix foaf: <http://xmlns.com/foaf/0.1/> .' END AS declaration FROM customer")
def doc_extract_prefix(spark, sf_dir):
    made = D.extract_prefix(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("http://xmlns.com/foaf/0.1/x"), K())).when(F.col("c_custkey") % 4 == 1, "http://nowhere/x").otherwise("http://xmlns.com/foaf/0.1/"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), made["replacement"].alias("replacement"), made["declaration"].alias("declaration"))


@register("SELECT doc_id, coalesce(instr(text, '.'), 0) AS stop FROM documents")
def doc_statement_bounds(spark, sf_dir):
    """Where the statement ends that the first character is in."""
    text = F.concat(F.lit("x"), F.col("text"), F.lit("."))
    bounds = D.statement_bounds(text, F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.when(bounds["end"] == F.length(text), F.when(F.endswith("text", F.lit(".")) & (F.locate(".", "text") == F.length("text")), F.length("text")).otherwise(0)).otherwise(bounds["end"] - 1), F.lit(0)).cast("long").alias("stop"))


@register("SELECT 'd' || c_custkey AS path, c_custkey % 2 = 0 AS fatal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def doc_fatal(spark, sf_dir):
    """Errors are fatal, warnings aren't."""
    text = F.when(F.col("c_custkey") % 2 == 0, "<urn:a> <urn:b> .").when(F.col("c_custkey") % 3 == 0, "﻿<urn:a> <urn:b> <urn:c> .").otherwise("<urn:a> <urn:b> <urn:c> .")
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), K()).alias("path"), F.lit("ttl").alias("lang"), text.alias("content"))
    return D.is_fatal(D.diagnostics(reader.parse(docs)))


@register("SELECT c_custkey AS k, 'error[E1]: no' || chr(10) || ' --> f.ttl:3:5' || chr(10) || '  |' || chr(10) || '3 | ' || c_name || chr(10) || '  |     ^^^' AS shown FROM customer")
def doc_carets(spark, sf_dir):
    made = D.render(F.lit("error"), F.lit("E1"), F.lit("no"), F.lit("f.ttl"), F.col("c_name"), F.lit(2), F.lit(4), F.lit(7))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), made.alias("shown"))


@register("SELECT 'd' || c_custkey AS path FROM customer WHERE c_custkey % 4 = 0")
def doc_changed(spark, sf_dir):
    docs = rdf_docs(spark, sf_dir)
    number = F.substring("path", 2, 20).cast("long")
    seen = docs.select("path", F.sha2(F.when(number % 4 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("hash"))
    return D.changed(docs, seen).select("path")


@register("SELECT 'd' || c_custkey AS path, 1 AS line, 8 AS start, 11 AS \"end\" FROM customer")
def doc_rename_variable(spark, sf_dir):
    """What looks like the variable in a string or a comment stays."""
    text = told("SELECT ?nam # ?nam no more\nWHERE {?nam <http://e/?nam> '?nam' , ?name }".replace("SELECT ?nam", "SELECT *"))
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), K()).alias("path"), F.lit("sparql").alias("lang"), text.alias("text"))
    return D.rename(docs, "nam", "other", variable=True).select("path", "line", "start", "end")


@register("SELECT page_id, 'http://e/p/' || page_id AS one, 'http://e/q?' || page_id AS two, 'http://o/x' AS three FROM pages")
def iri_resolve_rows(spark, sf_dir):
    """Each row against its own base: by path, with a query, and an authority of its own."""
    n = F.col("page_id").cast("string")
    base = F.concat(F.lit("http://e/p/base?z="), n)
    return table(spark, sf_dir, "pages").select("page_id", I.resolve(base, n).alias("one"), I.resolve(base, F.concat(F.lit("../q?"), n)).alias("two"), I.resolve(base, F.lit("//o/x")).alias("three"))


def edited_docs(spark, sf_dir, edited: bool) -> DataFrame:
    """A document of all customers of a nation, of which an edit changes the statement of each hundredth customer and moves all others."""
    k = F.col("c_custkey")
    name = F.when((k % 100 == 0) & F.lit(edited), F.concat("c_name", F.lit(" again"))).otherwise(F.col("c_name"))
    one = F.format_string('c:%d n:name "%s." ;\n  n:sees [ n:of c:%d ] . # a dot.\n', k, name, k)
    head = "@prefix c: <urn:c:> .\n@prefix n: <urn:n:> .\n"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", one.alias("t")))), lambda x: x["t"]), "\n" if edited else "")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("# moved\n" if edited else ""), F.lit(head), body).alias("content")).select(F.concat(F.col("c_nationkey").cast("string"), F.lit(".ttl")).alias("path"), "content")


@register("SELECT 'c:' || c_custkey AS c FROM customer WHERE c_custkey % 100 = 0")
def doc_reparsed_statements(spark, sf_dir):
    """The statements that an edit makes a parser read again: those that it changed."""
    known = reparsed(edited_docs(spark, sf_dir, False))[1]
    new = reparsed(edited_docs(spark, sf_dir, True), known)[2]
    return new.select(F.regexp_extract(F.col("text").cast("string"), r"\n(c:\d+) ", 1).alias("c"))


@register("""WITH s AS (SELECT c_nationkey || '.ttl' AS doc_id, c_custkey AS k, '<urn:c:' || c_custkey || '>' AS c, '"' || c_name || CASE WHEN c_custkey % 100 = 0 THEN ' again' ELSE '' END || '."' AS name FROM customer)
SELECT doc_id, c AS s, '<urn:n:name>' AS p, name AS o FROM s UNION ALL SELECT doc_id, 'node', '<urn:n:of>', c FROM s UNION ALL SELECT doc_id, c, '<urn:n:sees>', 'node' FROM s""")
def doc_reparsed_facts(spark, sf_dir):
    """The facts after an edit, most of them taken from before it."""
    known = reparsed(edited_docs(spark, sf_dir, False))[1]
    facts = reparsed(edited_docs(spark, sf_dir, True), known)[0]
    blind = lambda c: F.when(T.is_bnode(F.col(c)), "node").otherwise(F.col(c)).alias(c)
    return facts.select("doc_id", blind("s"), "p", blind("o"))


# -- what the queries before leave open: rows where those have none, whole outputs where those have counts
ask("sparql_minus_rows", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n MINUS { ?o <urn:t:o_custkey> ?c ; <urn:t:o_orderkey> ?k FILTER(?k < 500) } }", "customer orders", "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 500)", n="text")
ask("sparql_optional_filter_rows", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n OPTIONAL { ?o <urn:t:o_custkey> ?c ; <urn:t:o_orderstatus> ?s ; <urn:t:o_orderkey> ?k FILTER(?k < 500) } FILTER(!BOUND(?s) || ?s + 1 > 0) }", "customer orders", "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 500)", n="text")
ask("sparql_loose_join_rows", "SELECT ?n ?r ?t WHERE { ?x <urn:t:n_name> ?n OPTIONAL { ?x <urn:t:n_regionkey> ?r . ?r <urn:t:r_regionkey> ?k FILTER(?k < 2) } { SELECT ?r ?t WHERE { ?r <urn:t:r_name> ?t } } }", "nation region", "SELECT n_name AS n, 'urn:t:region:' || r_regionkey AS r, r_name AS t FROM nation JOIN region ON n_regionkey >= 2 OR r_regionkey = n_regionkey", n="text", r="iri", t="text")


@register("SELECT CAST(c_custkey AS VARCHAR) AS c0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 7)")
def datalog_negation_rows(spark, sf_dir):
    """A negated atom with a constant."""
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("c0"), (F.col("o_orderkey") % 50).cast("string").alias("c1"))
    return datalog(spark, "idle(C) :- cust(C), not ordered(C, 7).", {"cust": table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c0")), "ordered": ordered}, "idle", 1)


@register("SELECT CAST(o_custkey AS VARCHAR) AS c0, '\"F\"' AS c1 FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'none', '\"F\"'")
def datalog_constants_rows(spark, sf_dir):
    """Constants in bodies and heads, quoted and bare, over a table."""
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("c0"), F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')).alias("c1"))
    return datalog(spark, 'done(C, "F") :- ordered(C, "F"). done(none, "F").', {"ordered": ordered}, "done", 2)


SX = "<urn:x-shex-syntax:"
@register("SELECT c_custkey AS k, p, o, n FROM customer, (VALUES ('fact', '', 1), ('rule', '', 1), ('head', '', 1), ('body', '', 2), ('negated', '\"true\"', 1), ('atom', '\"p\"', 2), ('atom', '\"q\"', 1), ('atom', '\"r\"', 1), ('atom', '', 2), ('arg', '\"?X\"', 3), ('arg', '\"a\"', 1), ('arg', '', 5)) v(p, o, n) UNION ALL SELECT c_custkey, 'arg', '\"' || c_custkey || '\"', 1 FROM customer")
def encode_datalog_rows(spark, sf_dir):
    """All facts of a program, counted by what they say; nodes have no names."""
    docs = table(spark, sf_dir, "customer").select(K().alias("path"), F.lit("datalog").alias("lang"), told("p(KEY). q(X, a) :- p(X), not r(X).").alias("content"))
    facts = reader.facts_of(reader.parse(docs))
    return facts.groupBy(F.col("doc_id").cast("long").alias("k"), F.regexp_extract("p", r":(\w+)>$", 1).alias("p"), F.when(T.is_bnode(F.col("o")), "").otherwise(F.col("o")).alias("o")).agg(F.count(F.lit(1)).cast("int").alias("n"))


document(
    "encode_shex_rows", "shex", "PREFIX e: <http://e/> <http://e/S> CLOSED EXTRA e:p { e:p IRI {KEY,} ; ^e:q [ 1 2 ] ? }",
    (f"{SX}schema>", f"{SX}prefix>", '"e: <http://e/>"'), (f"{SX}schema>", f"{SX}shape>", "<http://e/S>"), ("<http://e/S>", f"{SX}shape/closed>", '"true"'), ("<http://e/S>", f"{SX}shape/tripleConstraint>", "_:c0"), ("<http://e/S>", f"{SX}shape/tripleConstraint>", "_:c1"),
    ("_:c0", f"{SX}tc/predicate>", "<http://e/p>"), ("_:c0", f"{SX}tc/cardinality>", '"KEY,*"'), ("_:c0", f"{SX}tc/valueConstraint>", '"iri"'),
    ("_:c1", f"{SX}tc/predicate>", "<http://e/q>"), ("_:c1", f"{SX}tc/inverse>", '"true"'), ("_:c1", f"{SX}tc/cardinality>", '"0,1"'), ("_:c1", f"{SX}tc/valueConstraint>", r'"[\"1\"^^<http://www.w3.org/2001/XMLSchema#integer> \"2\"^^<http://www.w3.org/2001/XMLSchema#integer>]"'),
)


@register("SELECT '<urn:d\\u0020\\u007B' || doc_id || '\\u007D\\u005C> <urn:t> \"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\" .' AS value FROM documents WHERE text IS NOT NULL")
def sink_escaped_lines(spark, sf_dir):
    """Lines as they are written, of IRIs and texts that hold what must be escaped."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return sinks.ntriples(d.select(F.concat(F.lit("<urn:d {"), F.col("doc_id").cast("string"), F.lit("}\\>")).alias("s"), F.lit("<urn:t>").alias("p"), T.string(F.col("text")).alias("o")))


def graph_facts(spark, sf_dir) -> DataFrame:
    """Names and segments of customers in documents of their nations, those of every third customer in the default graph."""
    c = table(spark, sf_dir, "customer")
    pairs = F.explode(F.array(F.struct(F.lit("<urn:p:name>").alias("p"), T.string(F.col("c_name")).alias("o")), F.struct(F.lit("<urn:q>").alias("p"), T.string(F.concat("c_mktsegment", F.lit('"é'))).alias("o"))))
    graph = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("<urn:g:"), (F.col("c_custkey") % 3).cast("string"), F.lit(">")))
    return c.select(F.col("c_nationkey").cast("string").alias("doc_id"), F.concat(F.lit("<urn:c:"), K(), F.lit(">")).alias("s"), pairs.alias("x"), graph.alias("g")).select("doc_id", "s", "x.p", "x.o", "g")


STATEMENTS = "SELECT c_nationkey AS n, c_custkey AS k, '<urn:c:' || c_custkey || '>' AS s, 0 AS i, 'p:name \"' || c_name || '\" .' AS line FROM customer UNION ALL SELECT c_nationkey, c_custkey, '<urn:c:' || c_custkey || '>', 1, '<urn:q> \"\"\"' || c_mktsegment || '\"é\"\"\" .' FROM customer"
HEADS = "SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, line FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES ('@prefix p: <urn:p:> .'), ('')) v(line)"


@register(f"SELECT CAST(n AS VARCHAR) AS doc_id, s || ' ' || line AS line FROM ({STATEMENTS}) UNION ALL {HEADS}")
def sink_turtle_lines(spark, sf_dir):
    """Documents of any size as lines."""
    return sinks.turtle_lines(graph_facts(spark, sf_dir), {"p": "urn:p:"})


@register(f"""WITH l AS (SELECT CAST(n AS VARCHAR) AS doc_id, '    ' || s || ' ' || line AS line FROM ({STATEMENTS}) UNION ALL {HEADS} UNION ALL SELECT DISTINCT CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN '{{' ELSE '<urn:g:' || c_custkey % 3 || '> {{' END FROM customer
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), '}}' FROM (SELECT DISTINCT c_nationkey, c_custkey % 3 FROM customer)) SELECT * FROM l""")
def sink_trig_lines(spark, sf_dir):
    return sinks.trig_lines(graph_facts(spark, sf_dir), {"p": "urn:p:"})


@register(f"""WITH l AS (SELECT n, k % 3 AS g, '    ' || string_agg(s || ' ' || line, chr(10) || '    ' ORDER BY s, i) AS body FROM ({STATEMENTS}) GROUP BY ALL)
SELECT CAST(n AS VARCHAR) AS doc_id, '@prefix p: <urn:p:> .' || chr(10) || chr(10) || string_agg(CASE WHEN g = 0 THEN '' ELSE '<urn:g:' || g || '> ' END || '{{' || chr(10) || body || chr(10) || '}}' || chr(10), '' ORDER BY g) AS text FROM l GROUP BY n""")
def sink_trig_texts(spark, sf_dir):
    """Whole documents, as they are formatted."""
    return sinks.formatted(graph_facts(spark, sf_dir), "trig", {"p": "urn:p:"})


@register("SELECT c_custkey AS k, n, v.n % 2 = 0 AS accepted, CASE WHEN n % 2 = 1 THEN code END AS code FROM customer, (VALUES (0, ''), (1, 'SPARQL-AGG-001'), (2, ''), (3, 'SPARQL-AGG-001')) v(n, code)")
def sparql_static_checks(spark, sf_dir):
    """What a grouped query may project is told before anything runs."""
    texts = ["SELECT ?x (COUNT(?y) AS ?c) WHERE { ?x <urn:KEY> ?y } GROUP BY ?x", "SELECT * WHERE { ?x <urn:KEY> ?y } GROUP BY ?x", "SELECT (STR(?x) AS ?z) WHERE { ?x <urn:KEY> ?y } GROUP BY ?x", "SELECT ?x ?y WHERE { ?x <urn:KEY> ?y } GROUP BY ?x"]
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")  # once for four documents each
    docs = customers.select(K().alias("k"), F.posexplode(F.array(*map(told, texts))).alias("n", "content"))
    made = reader.check(docs.select(F.concat_ws("-", "k", "n").alias("path"), F.lit("sparql").alias("lang"), "content"), deal=False)
    at = F.split("path", "-")
    return made.select(at[0].cast("long").alias("k"), at[1].cast("int").alias("n"), "accepted", F.regexp_extract(F.try_element_at("errors", F.lit(1)), r"^([A-Z]+-[A-Z]+-\d+)", 1).alias("code"))


@register("SELECT 'c' || c_custkey || '.' || lang AS doc_id, 'http://b/' || c_custkey || '/x/y' AS s, 'http://b/p' AS p, 'http://b/' || c_custkey || '/d/o?q#f' AS o FROM customer, (VALUES ('ttl'), ('n3'), ('rdf'), ('jsonld')) v(lang)")
def parse_local_resolvers(spark, sf_dir):
    """One reference each by a path, a root and dots, with a query and a fragment, resolved by the languages' own readers."""
    texts = {
        "ttl": "<../x/y> </p> <./o?q#f> .", "n3": "<../x/y> </p> <./o?q#f> .",
        "rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:b="http://b/"><rdf:Description rdf:about="../x/y"><b:p rdf:resource="./o?q#f"/></rdf:Description></rdf:RDF>',
        "jsonld": '{"@id": "../x/y", "http://b/p": {"@id": "./o?q#f"}}',
    }
    c = table(spark, sf_dir, "customer")
    docs = c.select(K().alias("k"), F.explode(F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))).alias("ext", "content"))
    made = reader.parse(docs.select(F.concat(F.lit("c"), F.col("k"), F.lit("."), F.col("ext")).alias("path"), F.concat(F.lit("http://b/"), F.col("k"), F.lit("/d/e")).alias("base"), "content"))
    return reader.facts_of(made).select("doc_id", *(T.iri_text(F.col(x)).alias(x) for x in ("s", "p", "o")))


@register("SELECT doc_id, length(h) - length(replace(h, chr(10), '')) AS line, CASE WHEN contains(h, chr(10)) THEN instr(reverse(h), chr(10)) - 1 ELSE length(h) END AS \"column\" FROM (SELECT doc_id, substr(text, 1, length(text) // 2) AS h FROM documents WHERE text IS NOT NULL)")
def doc_positions(spark, sf_dir):
    """The line and the column of the middle of each text."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    place = D.position(F.col("text"), F.floor(F.char_length("text") / 2).cast("int"))
    return d.select("doc_id", place["line"].cast("long").alias("line"), place["column"].cast("long").alias("column"))


@register("SELECT c_custkey AS k, n, v.t || CASE n WHEN 1 THEN c_custkey::VARCHAR ELSE '' END AS word FROM customer, (VALUES (0, 'e:some-name'), (1, 'urn:'), (2, ''), (3, '@prefix')) v(n, t)")
def doc_token_at(spark, sf_dir):
    """The word around an offset: within, at its end, between words, and at the start of the text."""
    text = told('@prefix e: <e:> ; e:some-name, (urn:KEY) .')
    at = {0: F.lit(22), 1: F.length(text) - 3, 2: F.lit(16), 3: F.lit(0)}
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*(F.struct(F.lit(n).alias("n"), D.token_at(text, o).alias("word")) for n, o in at.items()))).alias("x")).select("k", "x.n", "x.word")


@register("SELECT 'd' || c_custkey || l AS path, name, kind, line FROM customer, (VALUES ('sparql', '?x', 'variable', 0), ('sparql', '?long_name', 'variable', 0), ('sparql', '?z', 'variable', 1), ('shex', 'http://e/S', 'shape', 1), ('shex', 'http://e/T', 'shape', 3), ('datalog', 'edge', 'relation', 1), ('datalog', 'path', 'relation', 2)) v(l, name, kind, line)")
def doc_symbols_others(spark, sf_dir):
    """Variables, shapes and relations, each where it first stands."""
    texts = {"sparql": "SELECT ?x ?long_name, (COUNT(?n) AS $m) # KEY\nWHERE { ?x <p> ?z. }", "shex": "PREFIX e: <http://e/>\n  <http://e/S> {\n e:p @<http://e/T> }\n<http://e/T> CLOSED { }\n<http://e/U> IRI", "datalog": "% no(x)\nedge(a, KEY).\npath (X, Y) :- edge(X, Y).\n:- odd(x).\npath(X, Z) :- path(X, Y), edge(Y, Z)."}
    docs = table(spark, sf_dir, "customer").select(K().alias("k"), F.explode(F.create_map(*(x for k, v in texts.items() for x in (F.lit(k), told(v))))).alias("lang", "text"))
    return D.symbols(docs.select(F.concat(F.lit("d"), "k", "lang").alias("path"), "lang", "text"))


__all__ = ["QUERIES", "SQL"]
