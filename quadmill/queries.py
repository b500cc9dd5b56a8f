"""The registered queries over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import iri as I
from .functions import terms as T
from .operators import documents as D
from .operators import facts as O
from .plans.datalog import datalog
from .plans.mapping import Facts, mapped
from .plans.shex import validate
from .plans.sparql import Engine, sparql
from .plans.update import update
from .session import dealt
from .sources import reader, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decoded(df: DataFrame, **kinds: str) -> DataFrame:
    """Terms as values: long, double, text (of a literal), iri (its text), bool or term."""
    how = {
        "long": lambda c: T.raw_lexical(c).cast("double").cast("long"), "double": lambda c: T.to_double(c), "text": T.lexical, "iri": T.iri_text, "bool": T.to_boolean, "term": lambda c: c,
    }
    return df.select(*(how[k](F.col(f"`{n}`")).alias(n) for n, k in kinds.items()))


def ask(name: str, text: str, tables: str, sql: str, **kinds: str) -> None:
    """Registers a SPARQL query over a virtual graph of tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decoded(sparql(spark, mapped(spark, sf_dir, *tables.split()), text), **kinds)

    run.__name__ = name
    register(sql)(run)


# -- facts: canonical forms, sets, differences


@register("SELECT '<urn:t:nation:' || n_nationkey || '>' AS s, '<urn:t:n_name>' AS p, '\"' || n_name || '\"' AS o FROM nation UNION ALL SELECT '<urn:t:nation:' || n_nationkey || '>', '<urn:t:n_regionkey>', '<urn:t:region:' || n_regionkey || '>' FROM nation UNION ALL SELECT '<urn:t:nation:' || n_nationkey || '>', '<urn:t:n_nationkey>', '\"' || n_nationkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM nation")
def facts_map_nation(spark, sf_dir):
    return mapped(spark, sf_dir, "nation").quads().select("s", "p", "o")


@register("SELECT DISTINCT '<urn:t:customer:' || o_custkey || '>' AS s, '<urn:t:status>' AS p, '\"' || o_orderstatus || '\"' AS o FROM orders")
def facts_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    facts = o.select(F.lit("d").alias("doc_id"), F.concat(F.lit("<urn:t:customer:"), F.col("o_custkey").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:t:status>").alias("p"), T.string(F.col("o_orderstatus")).alias("o"), F.lit(None).cast("string").alias("g"), F.col("o_orderkey").alias("src_offset"))
    return O.deduplicated(facts).select("s", "p", "o")


@register("SELECT doc_id, lang || CASE doc_id % 4 WHEN 0 THEN '-Latn-US' WHEN 1 THEN '-US' WHEN 2 THEN '-419' ELSE '-1996' END AS tag FROM documents")
def facts_langtag_fold(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.upper("lang"), F.when(F.col("doc_id") % 4 == 0, "-lATN-us").when(F.col("doc_id") % 4 == 1, "-us").when(F.col("doc_id") % 4 == 2, "-419").otherwise("-1996"))
    return d.select("doc_id", T.language(T.canonical(F.concat(F.lit('"x"@'), raw))).alias("tag"))


@register("SELECT page_id, '<' || url || '>' AS term, 'urn:p:' || page_id AS bare FROM pages")
def facts_wrap_iri(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical(F.col("url")).alias("term"), T.canonical(F.concat(F.lit("urn:p:"), F.col("page_id").cast("string"))).alias("bare"))


@register("SELECT doc_id, text AS lex, lang AS tag FROM documents")
def facts_split_literal(spark, sf_dir):
    term = F.concat(T.string(F.col("text")), F.lit("@"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.lexical(term).alias("lex"), T.language(term).alias("tag"))


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'p' ELSE 'g' END AS place FROM customer WHERE c_custkey % 3 <> 2")
def facts_check_canonical(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    facts = c.select("c_custkey", F.concat(F.lit("<urn:c:"), F.col("c_custkey").cast("string"), F.lit(">")).alias("s"), F.when(k == 0, "_:p").otherwise("<urn:p>").alias("p"), T.string(F.col("c_name")).alias("o"), F.when(k == 1, "graph").alias("g"))
    return O.violations(facts).select("c_custkey", "place")


@register("SELECT o_custkey AS doc, o_orderkey AS k, '_:c' || (row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END, o_orderkey) - 1) AS label FROM orders")
def facts_bnode_relabel(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    facts = o.select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("_:z"), (F.col("o_orderkey") * 7919 % 100003).cast("string"), F.lit("x"), F.col("o_orderkey").cast("string")).alias("s"), F.when(F.col("o_orderkey") % 2 == 0, "<urn:p:a>").otherwise("<urn:p:b>").alias("p"), T.typed(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "string").alias("o"), F.lit(None).cast("string").alias("g"), F.col("o_orderkey").alias("src_offset"))
    out = O.canonicalise(facts)
    return out.select(F.col("doc_id").cast("long").alias("doc"), T.lexical(F.col("o")).cast("long").alias("k"), F.col("s").alias("label"))


def versions(spark, sf_dir, n: int) -> DataFrame:
    """Facts of customers, of which version 2 lacks every seventh, and 2 and 3 have other names for some."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.col("c_name") if n == 1 else F.when(k % 11 == 0, F.concat("c_name", F.lit(f" v{n}"))).otherwise(F.col("c_name"))
    name = F.when(k % 13 == 0, F.concat("c_name", F.lit(" w"))).otherwise(name) if n == 3 else name
    df = c.select(F.concat(F.lit("<urn:c:"), k.cast("string"), F.lit(">")).alias("s"), F.lit("<urn:name>").alias("p"), T.string(name).alias("o"), F.lit(None).cast("string").alias("g"))
    return df.join(c.where(k % 7 == 0).select(F.concat(F.lit("<urn:c:"), k.cast("string"), F.lit(">")).alias("s")), "s", "left_anti") if n == 2 else df


@register("SELECT 'FactOnlyIn' AS kind, '<urn:c:' || c_custkey || '>' AS s, 'one' AS parser_id, '\"' || c_name || '\"' AS o FROM customer WHERE c_custkey % 7 = 0")
def diff_only_in(spark, sf_dir):
    return O.diff(versions(spark, sf_dir, 1), versions(spark, sf_dir, 2), "one", "two").where("kind = 'FactOnlyIn'").select("kind", "s", "parser_id", "o")


@register("SELECT 'ObjectMismatch' AS kind, '<urn:c:' || c_custkey || '>' AS s, 'one' AS parser_id, '\"' || c_name || '\"' AS o FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0 UNION ALL SELECT 'ObjectMismatch', '<urn:c:' || c_custkey || '>', 'two', '\"' || c_name || ' v2\"' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0")
def diff_object_mismatch(spark, sf_dir):
    return O.diff(versions(spark, sf_dir, 1), versions(spark, sf_dir, 2), "one", "two").where("kind = 'ObjectMismatch'").select("kind", "s", "parser_id", "o")


@register("""WITH c AS (SELECT c_custkey AS k, '<urn:c:' || c_custkey || '>' AS s, c_name AS a, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN c_name || ' v2' ELSE c_name END AS b, CASE WHEN c_custkey % 13 = 0 THEN c_name || ' w' WHEN c_custkey % 11 = 0 THEN c_name || ' v3' ELSE c_name END AS c FROM customer),
u AS (SELECT s, 'a' AS parser_id, a AS o FROM c UNION ALL SELECT s, 'b', b FROM c UNION ALL SELECT s, 'c', c FROM c), v AS (SELECT *, count(*) OVER (PARTITION BY s, o) AS n FROM u)
SELECT CASE WHEN o IS NULL THEN 'FactOnlyIn' ELSE 'ObjectMismatch' END AS kind, s, parser_id, CASE WHEN o IS NULL THEN '' ELSE '"' || o || '"' END AS o FROM v WHERE n < 2""")
def diff_many_majority(spark, sf_dir):
    return O.diff_many({x: versions(spark, sf_dir, i + 1) for i, x in enumerate("abc")}).select("kind", "s", "parser_id", "o")


@register("SELECT '<urn:t:region:' || r_regionkey || '>' AS s, '<urn:t:r_name>' AS p, ['\"' || r_name || '\"'] AS objects FROM region")
def facts_key_index(spark, sf_dir):
    return O.key_index(mapped(spark, sf_dir, "region").quads("<urn:t:r_name>")).select("s", "p", "objects")


@register("SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE quality = 0) AS BIGINT) AS failed, count(*) FILTER (WHERE quality = 0) = 0 AS open FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 <> 0 GROUP BY lang")
def gate_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    verdicts = d.select("lang", F.col("doc_id").cast("string").alias("name"), (F.col("quality") == 1).alias("pass"))
    return O.gate(O.allowed(verdicts, d.where("doc_id % 5 = 0").select("lang", F.col("doc_id").cast("string").alias("name"))))


@register("SELECT c_custkey AS path, 'AcceptRejectSplit' AS kind, c_custkey % 2 = 0 AS accepted_a, c_custkey % 3 = 0 AS accepted_b FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)")
def accept_reject_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return O.accept_split(c.select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 2 == 0).alias("accepted")), c.select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 3 == 0).alias("accepted")))


# -- sources and sinks: facts written and read again

#: Rows of a table whose facts share a document: larger tables make more documents, not larger ones, as each is parsed whole.
SHARED = 64


def shared(key: Column, extension: str) -> Column:
    """The name of the document that holds the facts of a key."""
    return F.concat(F.floor(key / SHARED).cast("string"), F.lit(extension))


CUSTOMER_SQL = """SELECT '<urn:t:customer:' || c_custkey || '>' AS s, '<urn:t:c_name>' AS p, '"' || c_name || '"' AS o FROM customer UNION ALL SELECT '<urn:t:customer:' || c_custkey || '>', '<urn:t:c_nationkey>', '<urn:t:nation:' || c_nationkey || '>' FROM customer"""


def customer_facts(spark, sf_dir) -> DataFrame:
    m = mapped(spark, sf_dir, "customer")
    return m.quads("<urn:t:c_name>").union(m.quads("<urn:t:c_nationkey>"))


def customer_key(column: str) -> Column:
    """The number of the customer whose fact a term or a line begins with."""
    return F.regexp_extract(column, r"^<urn:t:customer:(\d+)>", 1).cast("long")


@register(CUSTOMER_SQL)
def nt_roundtrip(spark, sf_dir):
    """Lines grouped into documents by customer, parsed again."""
    docs = sinks.ntriples(customer_facts(spark, sf_dir)).groupBy(shared(customer_key("value"), ".nt").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("content"))
    return reader.facts_of(reader.parse(docs)).select("s", "p", "o")


@register(CUSTOMER_SQL.replace(" AS o FROM", " AS o, '<urn:g:' || c_custkey % 3 || '>' AS g FROM").replace("'>' FROM", "'>', '<urn:g:' || c_custkey % 3 || '>' FROM"))
def nq_roundtrip(spark, sf_dir):
    key = F.regexp_extract("s", r":(\d+)>$", 1).cast("long") % 3
    facts = customer_facts(spark, sf_dir).withColumn("g", F.concat(F.lit("<urn:g:"), key.cast("string"), F.lit(">")))
    docs = sinks.nquads(facts).groupBy(shared(customer_key("value"), ".nq").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("content"))
    return reader.facts_of(reader.parse(docs)).select("s", "p", "o", "g")


@register(CUSTOMER_SQL)
def turtle_roundtrip(spark, sf_dir):
    facts = customer_facts(spark, sf_dir).withColumn("doc_id", shared(customer_key("s"), ".ttl"))
    docs = sinks.turtle(facts, {"t": "urn:t:", "c": "urn:t:customer:"}).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return reader.facts_of(reader.parse(docs)).select("s", "p", "o")


@register(CUSTOMER_SQL.replace(" AS o FROM", " AS o, CASE WHEN c_custkey % 3 > 0 THEN '<urn:g:' || c_custkey % 3 || '>' END AS g FROM").replace("'>' FROM", "'>', CASE WHEN c_custkey % 3 > 0 THEN '<urn:g:' || c_custkey % 3 || '>' END FROM"))
def trig_blocks(spark, sf_dir):
    key = F.regexp_extract("s", r":(\d+)>$", 1).cast("long") % 3
    facts = customer_facts(spark, sf_dir).withColumn("g", F.when(key > 0, F.concat(F.lit("<urn:g:"), key.cast("string"), F.lit(">")))).withColumn("doc_id", shared(customer_key("s"), ".trig"))
    docs = sinks.trig(facts, {"t": "urn:t:"}).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return reader.facts_of(reader.parse(docs)).select("s", "p", "o", "g")


@register("SELECT doc_id, text FROM documents")
def literal_roundtrip(spark, sf_dir):
    """Texts as literals through Turtle's short and long quotes."""
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    facts = d.select(shared(F.col("doc_id"), ".ttl").alias("doc_id"), F.concat(F.lit("<urn:d:"), F.col("doc_id").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:text>").alias("p"), T.string(F.col("text")).alias("o"), F.lit(None).cast("string").alias("g"))
    docs = sinks.turtle(facts, {}).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    out = reader.facts_of(reader.parse(docs), canonical=False)
    return out.select(F.regexp_extract("s", r"(\d+)>$", 1).cast("long").alias("doc_id"), T.lexical(F.col("o")).alias("text"))


def parsed_query(name: str, lang: str, content: Callable, sql: str) -> None:
    """One small document for each customer, parsed to facts."""

    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.lit(lang).alias("lang"), content().alias("content"))
        return reader.facts_of(reader.parse(docs)).select("doc_id", "s", "p", "o")

    run.__name__ = name
    register(sql)(run)


K = lambda: F.col("c_custkey").cast("string")
INTEGER = "^^<http://www.w3.org/2001/XMLSchema#integer>"
RDFNS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
PLAIN_SQL = "SELECT 'c' || c_custkey AS doc_id, '<http://e/' || c_custkey || '>' AS s, '<http://e/name>' AS p, '\"' || c_name || '\"' AS o FROM customer"
parsed_query("parse_rdfxml", "rdfxml", lambda: F.concat(F.lit(f'<rdf:RDF xmlns:rdf="{RDFNS}" xmlns:e="http://e/"><rdf:Description rdf:about="http://e/'), K(), F.lit('"><e:name>'), F.col("c_name"), F.lit("</e:name></rdf:Description></rdf:RDF>")), PLAIN_SQL)
parsed_query("parse_jsonld", "jsonld", lambda: F.concat(F.lit('{"@context": {"name": "http://e/name"}, "@id": "http://e/'), K(), F.lit('", "name": "'), F.col("c_name"), F.lit('"}')), PLAIN_SQL)
parsed_query("parse_trix", "trix", lambda: F.concat(F.lit("<TriX><graph><triple><uri>http://e/"), K(), F.lit("</uri><uri>http://e/name</uri><plainLiteral>"), F.col("c_name"), F.lit("</plainLiteral></triple></graph></TriX>")), PLAIN_SQL)
parsed_query("parse_n3", "n3", lambda: F.concat(F.lit("@prefix e: <http://e/> . <http://e/"), K(), F.lit('> e:name "'), F.col("c_name"), F.lit('" .')), PLAIN_SQL)
parsed_query(
    "parse_collection", "ttl", lambda: F.concat(F.lit("<http://e/"), K(), F.lit("> <http://e/l> ("), K(), F.lit(") .")),
    f"SELECT 'c' || c_custkey AS doc_id, '<http://e/' || c_custkey || '>' AS s, '<http://e/l>' AS p, '_:c0' AS o FROM customer UNION ALL SELECT 'c' || c_custkey, '_:c0', '<{RDFNS}first>', '\"' || c_custkey || '\"{INTEGER}' FROM customer UNION ALL SELECT 'c' || c_custkey, '_:c0', '<{RDFNS}rest>', '<{RDFNS}nil>' FROM customer",
)


@register("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE c_custkey % 4 > 0) AS BIGINT) AS accepted FROM customer")
def parse_outcomes(spark, sf_dir):
    """Every fourth document is cut off in the middle of a statement."""
    line = F.concat(F.lit("<urn:c:"), K(), F.lit("> <urn:p> "))
    docs = table(spark, sf_dir, "customer").select(F.concat(K(), F.lit(".nt")).alias("path"), F.when(F.col("c_custkey") % 4 == 0, line).otherwise(F.concat(line, F.lit('"x" .\n'))).alias("content"))
    return reader.parse(docs).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"))


@register("""SELECT name, p AS path, CASE p WHEN 'a.nt' THEN 'nt' WHEN 'b.ttl' THEN 'ttl' WHEN 'c.rq' THEN 'sparql' WHEN 'd.json-ld' THEN 'jsonld' END AS lang FROM (SELECT r_name AS name FROM region), (VALUES ('a.nt'), ('b.ttl'), ('c.rq'), ('d.json-ld'), ('e.zip')) v(p)""")
def format_dispatch(spark, sf_dir):
    paths = F.explode(F.array(*map(F.lit, ["a.nt", "b.ttl", "c.rq", "d.json-ld", "e.zip"])))
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), paths.alias("path")).select("name", "path", reader.language_of(F.col("path")).alias("lang"))


@register("SELECT r_name AS name, CASE r_regionkey % 2 WHEN 0 THEN 'PositiveSyntax' ELSE 'Eval' END AS kind, 'urn:a:' || r_regionkey AS action, CASE r_regionkey % 2 WHEN 1 THEN 'urn:r:' || r_regionkey END AS result FROM region")
def manifest_entries(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    k, mf = F.col("r_regionkey"), reader.MF
    subject = F.concat(F.lit("<urn:t:"), k.cast("string"), F.lit(">"))
    row = lambda p, o: F.struct(F.lit("m").alias("doc_id"), subject.alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o"))
    kind = F.when(k % 2 == 0, "<http://www.w3.org/ns/rdftest#TestTurtlePositiveSyntax>").otherwise("<http://www.w3.org/ns/rdftest#TestTurtleEval>")
    number = lambda name: F.concat(F.lit(f"<urn:{name}:"), k.cast("string"), F.lit(">"))
    facts = r.select(F.explode(F.array(row(RDFNS + "type", kind), row(mf + "name", T.string(F.col("r_name"))), row(mf + "action", number("a")), row(mf + "result", F.when(k % 2 == 1, number("r"))))).alias("x")).select("x.*").where("o IS NOT NULL")
    return reader.manifest_entries(facts).select("name", "kind", "action", "result")


# -- IRIs


@register(r"""SELECT page_id, regexp_extract(url, '^([^:/?#]+):', 1) AS scheme, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '\?([^#]*)', 1) END AS query, CASE WHEN url LIKE '%#%' THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages""")
def iri_components(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", I.scheme(u).alias("scheme"), I.host(u).alias("host"), I.path(u).alias("path"), I.query(u).alias("query"), I.fragment(u).alias("fragment"))


@register("SELECT page_id, url AS normal FROM pages")
def iri_normalise(spark, sf_dir):
    u = F.col("url")
    loud = F.concat(F.upper(I.scheme(u)), F.lit("://"), F.upper(I.host(u)), F.lit("/x/.."), I.path(u), F.coalesce(F.concat(F.lit("?"), I.query(u)), F.lit("")), F.coalesce(F.concat(F.lit("#"), I.fragment(u)), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", I.normalise(loud).alias("normal"))


#: The examples of RFC 3986, 5.4, against http://a/b/c/d;p?q.
RESOLVED = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s",
    "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x",
}


@register("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RESOLVED.items()) + ") v(ref, iri)")
def iri_resolve(spark, sf_dir):
    refs = spark.createDataFrame([(r,) for r in RESOLVED], "ref string")
    return refs.select("ref", I.resolve(F.lit("http://a/b/c/d;p?q"), F.col("ref")).alias("iri"))


@register("SELECT p_partkey, '/' || p_brand || '/' || p_size AS path FROM part")
def iri_dot_segments(spark, sf_dir):
    p = F.concat(F.lit("/a/./../"), F.col("p_brand"), F.lit("/b/../c/.././"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", I.remove_dots(p).alias("path"))


@register("SELECT page_id, page_id % 3 > 0 AS valid FROM pages")
def iri_valid(spark, sf_dir):
    bad = F.when(F.col("page_id") % 6 == 0, F.concat(F.col("url"), F.lit(" x"))).when(F.col("page_id") % 6 == 3, F.concat(F.col("url"), F.lit("%ED%A0%80"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", I.is_valid(bad).alias("valid"))


@register("SELECT page_id, 'http://xn--bcher-kva.example/%C3%A9?' || page_id AS uri FROM pages")
def iri_to_uri(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", I.to_uri(F.concat(F.lit("http://bücher.example/é?"), F.col("page_id").cast("string"))).alias("uri"))


@register("SELECT c_custkey, 'c:n' || c_custkey AS name, 't:x' || c_custkey AS other FROM customer")
def prefix_compact(spark, sf_dir):
    own = {"t": "urn:t:", "c": "urn:t:customer:"}
    term = lambda ns, x: F.concat(F.lit(f"<{ns}{x}"), K(), F.lit(">"))
    return table(spark, sf_dir, "customer").select("c_custkey", sinks.compact(term("urn:t:customer:", "n"), own).alias("name"), sinks.compact(term("urn:t:", "x"), own).alias("other"))


# -- SPARQL: patterns
ask("sparql_bgp_star", "SELECT ?n ?b ?m WHERE { ?c <urn:t:c_name> ?n ; <urn:t:c_acctbal> ?b ; <urn:t:c_mktsegment> ?m }", "customer", "SELECT c_name AS n, c_acctbal AS b, c_mktsegment AS m FROM customer", n="text", b="double", m="text")
ask("sparql_bgp_chain", "SELECT ?k ?cn ?nn ?rn WHERE { ?o <urn:t:o_orderkey> ?k ; <urn:t:o_custkey> ?c . ?c <urn:t:c_name> ?cn ; <urn:t:c_nationkey> ?n . ?n <urn:t:n_name> ?nn ; <urn:t:n_regionkey> ?r . ?r <urn:t:r_name> ?rn }", "orders customer nation region", "SELECT o_orderkey AS k, c_name AS cn, n_name AS nn, r_name AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", k="long", cn="text", nn="text", rn="text")
ask("sparql_filter", "SELECT ?n ?b WHERE { ?c <urn:t:c_name> ?n ; <urn:t:c_acctbal> ?b FILTER(?b > 5000 && ?b <= 9000.5 || ?n = 'Customer#000000001') }", "customer", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 9000.5 OR c_name = 'Customer#000000001'", n="text", b="double")
ask("sparql_optional", "SELECT ?n ?k WHERE { ?c <urn:t:c_name> ?n OPTIONAL { ?o <urn:t:o_custkey> ?c ; <urn:t:o_orderkey> ?k ; <urn:t:o_totalprice> ?p FILTER(?p > 200000) } }", "customer orders", "SELECT c_name AS n, o_orderkey AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000", n="text", k="long")
ask("sparql_optional_filter_err", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n OPTIONAL { ?o <urn:t:o_custkey> ?c ; <urn:t:o_orderstatus> ?s } FILTER(!BOUND(?s) || ?s + 1 > 0) }", "customer orders", "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", n="text")
ask("sparql_union", "SELECT ?n WHERE { { ?x <urn:t:c_name> ?n } UNION { ?x <urn:t:s_name> ?n } }", "customer supplier", "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier", n="text")
ask("sparql_minus", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n MINUS { ?o <urn:t:o_custkey> ?c } }", "customer orders", "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", n="text")
ask("sparql_minus_disjoint", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n MINUS { ?o <urn:t:o_orderstatus> ?s } }", "customer orders", "SELECT c_name AS n FROM customer", n="text")
ask("sparql_exists", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n FILTER EXISTS { ?o <urn:t:o_custkey> ?c ; <urn:t:o_totalprice> ?p FILTER(?p > 300000) } }", "customer orders", "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", n="text")
ask("sparql_not_exists", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n ; <urn:t:c_acctbal> ?b FILTER NOT EXISTS { ?o <urn:t:o_custkey> ?c ; <urn:t:o_totalprice> ?p FILTER(?p > ?b * 20) } }", "customer orders", "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)", n="text")
ask("sparql_exists_in_expression", "SELECT ?n ?e WHERE { ?c <urn:t:c_name> ?n BIND((EXISTS { ?o <urn:t:o_custkey> ?c }) AS ?e) }", "customer orders", "SELECT c_name AS n, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS e FROM customer", n="text", e="bool")
ask("sparql_bind", "SELECT ?n ?d WHERE { ?c <urn:t:c_name> ?n ; <urn:t:c_acctbal> ?b BIND(?b * 2 + 1 AS ?d) }", "customer", "SELECT c_name AS n, c_acctbal * 2 + 1 AS d FROM customer", n="text", d="double")
ask("sparql_values", "SELECT ?n ?m WHERE { VALUES ?m { 'BUILDING' 'MACHINERY' } ?c <urn:t:c_mktsegment> ?m ; <urn:t:c_name> ?n }", "customer", "SELECT c_name AS n, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", n="text", m="text")
ask("sparql_values_undef", "SELECT ?n ?m WHERE { ?c <urn:t:c_mktsegment> ?m ; <urn:t:c_name> ?n VALUES (?n ?m) { (UNDEF 'BUILDING') ('Customer#000000002' UNDEF) } }", "customer", "SELECT c_name AS n, c_mktsegment AS m FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000002'", n="text", m="text")
ask("sparql_subselect", "SELECT ?n ?t WHERE { ?c <urn:t:c_name> ?n { SELECT ?c (ROUND(SUM(?p) * 100) / 100 AS ?t) WHERE { ?o <urn:t:o_custkey> ?c ; <urn:t:o_totalprice> ?p } GROUP BY ?c HAVING (COUNT(?o) > 12) } }", "customer orders", "SELECT c_name AS n, round(t, 2) AS t FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1 HAVING count(*) > 12) ON o_custkey = c_custkey", n="text", t="double")
ask("sparql_distinct", "SELECT DISTINCT ?s ?p WHERE { ?o <urn:t:o_orderstatus> ?s ; <urn:t:o_orderpriority> ?p }", "orders", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders", s="text", p="text")
ask("sparql_order_limit_offset", "SELECT ?n ?b WHERE { ?c <urn:t:c_name> ?n ; <urn:t:c_acctbal> ?b } ORDER BY DESC(?b) ?n LIMIT 20 OFFSET 5", "customer", "SELECT c_name AS n, c_acctbal AS b FROM customer ORDER BY b DESC, n LIMIT 20 OFFSET 5", n="text", b="double")
ask("sparql_variable_predicate", "SELECT ?p ?o WHERE { <urn:t:nation:3> ?p ?o }", "nation", "SELECT '<urn:t:n_name>' AS p, '\"' || n_name || '\"' AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '<urn:t:n_nationkey>', '\"3\"^^<http://www.w3.org/2001/XMLSchema#integer>' UNION ALL SELECT '<urn:t:n_regionkey>', '<urn:t:region:' || n_regionkey || '>' FROM nation WHERE n_nationkey = 3", p="term", o="term")


def by_region(name: str):
    """Nations are in a graph by the table's name, regions in the default one."""
    return F.concat(F.lit("<urn:g:"), (F.col("n_nationkey") % 3).cast("string"), F.lit(">")) if name == "nation" else F.lit(None).cast("string")


@register("SELECT '<urn:g:' || n_nationkey % 3 || '>' AS g, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def sparql_graph_var(spark, sf_dir):
    store = mapped(spark, sf_dir, "nation", "region", graph=by_region)
    return decoded(sparql(spark, store, "SELECT ?g ?n ?r WHERE { GRAPH ?g { ?x <urn:t:n_name> ?n ; <urn:t:n_regionkey> ?y } ?y <urn:t:r_name> ?r }"), g="term", n="text", r="text")


@register("SELECT n_name AS n FROM nation WHERE n_nationkey % 3 < 2")
def sparql_from(spark, sf_dir):
    store = mapped(spark, sf_dir, "nation", "region", graph=by_region)
    return decoded(sparql(spark, store, "SELECT ?n FROM <urn:g:0> FROM <urn:g:1> WHERE { ?x <urn:t:n_name> ?n }"), n="text")


@register("SELECT n_name AS n FROM nation WHERE n_nationkey % 3 = 2")
def sparql_from_named(spark, sf_dir):
    store = mapped(spark, sf_dir, "nation", "region", graph=by_region)
    return decoded(sparql(spark, store, "SELECT ?n FROM NAMED <urn:g:2> WHERE { GRAPH ?g { ?x <urn:t:n_name> ?n } }"), n="text")


@register("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def sparql_service(spark, sf_dir):
    far = {"<urn:far>": mapped(spark, sf_dir, "region")}
    return decoded(sparql(spark, mapped(spark, sf_dir, "nation"), "SELECT ?n ?r WHERE { ?x <urn:t:n_name> ?n ; <urn:t:n_regionkey> ?y SERVICE <urn:far> { ?y <urn:t:r_name> ?r } SERVICE SILENT <urn:none> { ?a ?b ?c } }", services=far), n="text", r="text")


@register("SELECT DISTINCT '<urn:t:region:' || n_regionkey || '>' AS s, '<urn:has>' AS p, '<urn:t:nation:' || n_nationkey || '>' AS o FROM nation")
def sparql_construct(spark, sf_dir):
    return sparql(spark, mapped(spark, sf_dir, "nation", "region"), "CONSTRUCT { ?r <urn:has> ?n } WHERE { ?n <urn:t:n_regionkey> ?r }")


@register("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS labels FROM nation")
def sparql_construct_bnode(spark, sf_dir):
    made = sparql(spark, mapped(spark, sf_dir, "nation"), "CONSTRUCT { _:x <urn:of> ?n } WHERE { ?n <urn:t:n_name> ?m }")
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("labels"))


@register("SELECT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7) AS answer")
def sparql_ask(spark, sf_dir):
    return sparql(spark, mapped(spark, sf_dir, "nation"), "ASK { ?x <urn:t:n_nationkey> 7 }")


@register("SELECT '<urn:t:region:1>' AS s, '<urn:t:r_name>' AS p, '\"' || r_name || '\"' AS o FROM region WHERE r_regionkey = 1 UNION ALL SELECT '<urn:t:region:1>', '<urn:t:r_regionkey>', '\"1\"^^<http://www.w3.org/2001/XMLSchema#integer>'")
def sparql_describe(spark, sf_dir):
    return sparql(spark, mapped(spark, sf_dir, "region"), "DESCRIBE <urn:t:region:1>")


# -- SPARQL: aggregates
ORDERS = "?o <urn:t:o_orderstatus> ?s ; <urn:t:o_totalprice> ?p ; <urn:t:o_orderkey> ?k ; <urn:t:o_custkey> ?c"
ask("sparql_agg_count", f"SELECT ?s (COUNT(*) AS ?n) (COUNT(?p) AS ?m) WHERE {{ {ORDERS} }} GROUP BY ?s", "orders", "SELECT o_orderstatus AS s, count(*) AS n, count(o_totalprice) AS m FROM orders GROUP BY 1", s="text", n="long", m="long")
ask("sparql_agg_sum", f"SELECT ?s (SUM(?k) AS ?t) WHERE {{ {ORDERS} }} GROUP BY ?s", "orders", "SELECT o_orderstatus AS s, CAST(sum(o_orderkey) AS BIGINT) AS t FROM orders GROUP BY 1", s="text", t="long")
ask("sparql_agg_avg", f"SELECT ?s (AVG(?k) AS ?a) WHERE {{ {ORDERS} }} GROUP BY ?s", "orders", "SELECT o_orderstatus AS s, avg(o_orderkey) AS a FROM orders GROUP BY 1", s="text", a="double")
ask("sparql_agg_minmax", f"SELECT ?s (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) WHERE {{ {ORDERS} }} GROUP BY ?s", "orders", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1", s="text", lo="double", hi="double")
ask("sparql_agg_sample", "SELECT ?r (SAMPLE(?n) AS ?x) WHERE { ?m <urn:t:n_regionkey> ?r ; <urn:t:n_name> ?n } GROUP BY ?r", "nation", "SELECT 'urn:t:region:' || n_regionkey AS r, min(n_name) AS x FROM nation GROUP BY 1", r="iri", x="text")
ask("sparql_agg_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?x) WHERE { ?m <urn:t:n_regionkey> ?r ; <urn:t:n_name> ?n } GROUP BY ?r", "nation", "SELECT 'urn:t:region:' || n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS x FROM nation GROUP BY 1", r="iri", x="text")
ask("sparql_agg_distinct", f"SELECT ?s (COUNT(DISTINCT ?c) AS ?n) (SUM(DISTINCT ?y) AS ?t) WHERE {{ {ORDERS} BIND(YEAR(?d) AS ?y) ?o <urn:t:o_orderdate> ?d }} GROUP BY ?s".replace("BIND(YEAR(?d) AS ?y) ?o <urn:t:o_orderdate> ?d", "; <urn:t:o_orderdate> ?d BIND(YEAR(?d) AS ?y)"), "orders", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT year(o_orderdate)) AS BIGINT) AS t FROM orders GROUP BY 1", s="text", n="long", t="long")
ask("sparql_agg_error", "SELECT ?m (SUM(?v) AS ?t) (COUNT(?v) AS ?n) WHERE { ?c <urn:t:c_mktsegment> ?m ; <urn:t:c_custkey> ?k ; <urn:t:c_name> ?x BIND(IF(?m = 'BUILDING' && ?k = 1 || ?m = 'MACHINERY', ?x, ?k) AS ?v) } GROUP BY ?m", "customer", "SELECT c_mktsegment AS m, CASE WHEN count(*) FILTER (WHERE c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' AND c_custkey = 1) = 0 THEN CAST(sum(c_custkey) AS BIGINT) END AS t, count(*) AS n FROM customer GROUP BY 1", m="text", t="long", n="long")
ask("sparql_having", "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o <urn:t:o_custkey> ?c } GROUP BY ?c HAVING (?n > 14)", "orders", "SELECT 'urn:t:customer:' || o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14", c="iri", n="long")
ask("sparql_group_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o <urn:t:o_orderdate> ?d } GROUP BY (YEAR(?d) AS ?y)", "orders", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1", y="long", n="long")
ask("sparql_implicit_group", "SELECT (COUNT(*) AS ?n) (MAX(?k) AS ?m) WHERE { ?o <urn:t:o_orderkey> ?k }", "orders", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders", n="long", m="long")

# -- SPARQL: functions
ask("sparql_fn_string", "SELECT ?n (STRLEN(?n) AS ?l) (SUBSTR(?n, 3, 4) AS ?u) (UCASE(?n) AS ?up) (LCASE(?n) AS ?lo) (CONTAINS(?n, '01') AS ?ct) (STRSTARTS(?n, 'Cu') AS ?st) (STRENDS(?n, '1') AS ?en) (STRBEFORE(?n, '#') AS ?be) (STRAFTER(?n, '#') AS ?af) (CONCAT(?n, '-', ?n) AS ?cc) (ENCODE_FOR_URI(?n) AS ?uri) (REPLACE(?n, '0+', 'z') AS ?re) WHERE { ?c <urn:t:c_name> ?n }", "customer", "SELECT c_name AS n, length(c_name) AS l, substr(c_name, 3, 4) AS u, upper(c_name) AS up, lower(c_name) AS lo, contains(c_name, '01') AS ct, starts_with(c_name, 'Cu') AS st, ends_with(c_name, '1') AS en, split_part(c_name, '#', 1) AS be, split_part(c_name, '#', 2) AS af, c_name || '-' || c_name AS cc, replace(c_name, '#', '%23') AS uri, regexp_replace(c_name, '0+', 'z', 'g') AS re FROM customer", n="text", l="long", u="text", up="text", lo="text", ct="bool", st="bool", en="bool", be="text", af="text", cc="text", uri="text", re="text")
ask("sparql_fn_math", "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (?k / 4 AS ?q) (-?k + 2 * 3 AS ?m) WHERE { ?x <urn:t:c_acctbal> ?b ; <urn:t:c_custkey> ?k }", "customer", "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r, c_custkey / 4 AS q, -c_custkey + 6 AS m FROM customer", k="long", a="double", c="double", f="double", r="double", q="double", m="long")
ask("sparql_fn_date", "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?a) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (SECONDS(?d) AS ?s) (TZ(?d) AS ?z) WHERE { ?o <urn:t:o_orderdate> ?d ; <urn:t:o_orderkey> ?k }", "orders", "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS a, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(minute(o_orderdate) AS BIGINT) AS i, CAST(second(o_orderdate) AS BIGINT) AS s, '' AS z FROM orders", k="long", y="long", m="long", a="long", h="long", i="long", s="long", z="text")
ask("sparql_fn_hash", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x <urn:t:c_name> ?n }", "customer", "SELECT c_name AS n, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer", n="text", a="text", b="text", c="text")
ask("sparql_fn_hash_long", "SELECT ?n (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) WHERE { ?x <urn:t:n_name> ?n }", "nation", "SELECT n_name AS n, 96 AS a, 128 AS b FROM nation", n="text", a="long", b="long")
ask("sparql_fn_term", "SELECT ?n (STR(?r) AS ?s) (DATATYPE(?k) AS ?d) (LANG(?n) AS ?l) (ISIRI(?r) AS ?i) (ISBLANK(?r) AS ?b) (ISLITERAL(?n) AS ?t) (ISNUMERIC(?k) AS ?m) (SAMETERM(?n, ?n) AS ?e) (STRDT(?n, <urn:d>) AS ?sd) (STRLANG(?n, 'EN-us') AS ?sl) (IRI(CONCAT('urn:x:', ?n)) AS ?u) (LANGMATCHES(LANG(STRLANG(?n, 'en-US')), 'EN') AS ?lm) WHERE { ?x <urn:t:n_name> ?n ; <urn:t:n_nationkey> ?k ; <urn:t:n_regionkey> ?r }", "nation", "SELECT n_name AS n, 'urn:t:region:' || n_regionkey AS s, 'http://www.w3.org/2001/XMLSchema#integer' AS d, '' AS l, true AS i, false AS b, true AS t, true AS m, true AS e, '\"' || n_name || '\"^^<urn:d>' AS sd, '\"' || n_name || '\"@en-US' AS sl, 'urn:x:' || n_name AS u, true AS lm FROM nation", n="text", s="text", d="iri", l="text", i="bool", b="bool", t="bool", m="bool", e="bool", sd="term", sl="term", u="iri", lm="bool")
ask("sparql_fn_cond", "SELECT ?n (IF(?k > 10, 'high', 'low') AS ?i) (COALESCE(?k / 0, ?zz, ?n) AS ?c) (?k IN (1, 2, 3) AS ?in) (?k NOT IN (1, 2) AS ?out) (!(?k = 3) AS ?not) WHERE { ?x <urn:t:n_name> ?n ; <urn:t:n_nationkey> ?k }", "nation", "SELECT n_name AS n, CASE WHEN n_nationkey > 10 THEN 'high' ELSE 'low' END AS i, n_name AS c, n_nationkey IN (1, 2, 3) AS \"in\", n_nationkey NOT IN (1, 2) AS out, n_nationkey <> 3 AS \"not\" FROM nation", **{"n": "text", "i": "text", "c": "text", "in": "bool", "out": "bool", "not": "bool"})
ask("sparql_fn_regex", "SELECT ?n WHERE { ?c <urn:t:c_name> ?n FILTER(REGEX(?n, 'customer.*[13]5$', 'i')) }", "customer", "SELECT c_name AS n FROM customer WHERE regexp_matches(c_name, '(?i)customer.*[13]5$')", n="text")
ask("sparql_cast", "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:double(xsd:string(?k)) AS ?d) (xsd:boolean(?k) AS ?t) WHERE { ?x <urn:t:c_acctbal> ?b ; <urn:t:c_custkey> ?k }", "customer", "SELECT c_custkey AS k, CAST(trunc(c_acctbal) AS BIGINT) AS i, CAST(c_custkey AS VARCHAR) AS s, CAST(c_custkey AS DOUBLE) AS d, c_custkey <> 0 AS t FROM customer", k="long", i="long", s="text", d="double", t="bool")


@register("SELECT CAST(count(*) AS BIGINT) AS n, true AS good, CAST(count(*) AS BIGINT) AS uuids FROM nation")
def sparql_fn_volatile(spark, sf_dir):
    df = sparql(spark, mapped(spark, sf_dir, "nation"), "SELECT ?n (RAND() AS ?r) (UUID() AS ?u) (STRUUID() AS ?s) (NOW() AS ?t) (BNODE() AS ?b) (BNODE(?n) AS ?c) WHERE { ?x <urn:t:n_name> ?n }")
    good = (T.to_double(F.col("r")) < 1) & F.startswith("u", F.lit("<urn:uuid:")) & (F.length(T.lexical(F.col("s"))) == 36) & T.to_timestamp(F.col("t")).isNotNull() & T.is_bnode(F.col("b")) & T.is_bnode(F.col("c"))
    return df.select(good.alias("good"), "u").agg(F.count(F.lit(1)).alias("n"), F.min("good").alias("good"), F.count_distinct("u").alias("uuids"))


# -- SPARQL: property paths
NATIONS = "SELECT 'urn:t:nation:' || a.n_nationkey AS a, 'urn:t:nation:' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"
ask("sparql_path_seq", "SELECT ?k ?n WHERE { ?o <urn:t:o_orderkey> ?k ; <urn:t:o_custkey>/<urn:t:c_nationkey>/<urn:t:n_name> ?n }", "orders customer nation", "SELECT o_orderkey AS k, n_name AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", k="long", n="text")
ask("sparql_path_alt", "SELECT ?n WHERE { ?x <urn:t:n_name>|<urn:t:r_name> ?n }", "nation region", "SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region", n="text")
ask("sparql_path_inv", "SELECT ?r ?n WHERE { ?r ^<urn:t:n_regionkey> ?n }", "nation", "SELECT 'urn:t:region:' || n_regionkey AS r, 'urn:t:nation:' || n_nationkey AS n FROM nation", r="iri", n="iri")
ask("sparql_path_opt", "SELECT ?x ?y WHERE { ?x <urn:t:n_regionkey>? ?y FILTER(ISIRI(?x)) }", "nation region", "SELECT 'urn:t:nation:' || n_nationkey AS x, 'urn:t:nation:' || n_nationkey AS y FROM nation UNION ALL SELECT 'urn:t:region:' || r_regionkey, 'urn:t:region:' || r_regionkey FROM region UNION ALL SELECT 'urn:t:nation:' || n_nationkey, 'urn:t:region:' || n_regionkey FROM nation", x="iri", y="iri")
ask("sparql_path_plus", "SELECT ?a ?b WHERE { ?a (<urn:t:n_regionkey>/^<urn:t:n_regionkey>)+ ?b }", "nation", NATIONS, a="iri", b="iri")
ask("sparql_path_star", "SELECT ?b WHERE { <urn:t:nation:1> (<urn:t:n_regionkey>|^<urn:t:n_regionkey>)* ?b }", "nation", "SELECT 'urn:t:nation:' || n_nationkey AS b FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) UNION ALL SELECT 'urn:t:region:' || n_regionkey FROM nation WHERE n_nationkey = 1", b="iri")
ask("sparql_path_neg", "SELECT ?x ?y WHERE { ?x !(<urn:t:n_name>|<urn:t:n_nationkey>) ?y }", "nation", "SELECT 'urn:t:nation:' || n_nationkey AS x, 'urn:t:region:' || n_regionkey AS y FROM nation", x="iri", y="iri")


# -- SPARQL Update


def updated(name: str, text: str, sql: str) -> None:
    """Registers an update of the facts of nation; regions are graphs."""

    def run(spark, sf_dir):
        n = table(spark, sf_dir, "nation")
        facts = n.select(F.concat(F.lit("<urn:n:"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:name>").alias("p"), T.string(F.col("n_name")).alias("o"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("<urn:r:"), F.col("n_regionkey").cast("string"), F.lit(">"))).alias("g"))
        return update(spark, facts, text)

    run.__name__ = name
    register(sql)(run)


BASE_SQL = "SELECT '<urn:n:' || n_nationkey || '>' AS s, '<urn:name>' AS p, '\"' || n_name || '\"' AS o, CASE WHEN n_regionkey > 0 THEN '<urn:r:' || n_regionkey || '>' END AS g FROM nation"
WHERE = BASE_SQL + " WHERE "
updated("sparql_update_insert", "INSERT DATA { <urn:x> <urn:name> 'new' . GRAPH <urn:r:1> { <urn:x> <urn:name> 'too' } }", BASE_SQL + " UNION ALL SELECT '<urn:x>', '<urn:name>', '\"new\"', NULL UNION ALL SELECT '<urn:x>', '<urn:name>', '\"too\"', '<urn:r:1>'")
updated("sparql_update_delete", "DELETE WHERE { GRAPH <urn:r:2> { ?x <urn:name> ?n } }", WHERE + "n_regionkey <> 2")
updated("sparql_update_delete_data", "DELETE DATA { GRAPH <urn:r:1> { <urn:n:1> <urn:name> 'NATION_1' } }", WHERE + "NOT (n_regionkey = 1 AND n_nationkey = 1 AND n_name = 'NATION_1')")
updated("sparql_update_modify", "DELETE { GRAPH ?g { ?x <urn:name> ?n } } INSERT { GRAPH ?g { ?x <urn:title> ?n } } WHERE { GRAPH ?g { ?x <urn:name> ?n } FILTER(?g != <urn:r:1>) }", WHERE + "n_regionkey < 2 UNION ALL SELECT '<urn:n:' || n_nationkey || '>', '<urn:title>', '\"' || n_name || '\"', '<urn:r:' || n_regionkey || '>' FROM nation WHERE n_regionkey >= 2")
updated("sparql_update_with", "WITH <urn:r:3> DELETE { ?x <urn:name> ?n } INSERT { ?x <urn:name> 'gone' } WHERE { ?x <urn:name> ?n }", WHERE + "n_regionkey <> 3 UNION ALL SELECT '<urn:n:' || n_nationkey || '>', '<urn:name>', '\"gone\"', '<urn:r:3>' FROM nation WHERE n_regionkey = 3")
updated("sparql_update_clear", "CLEAR GRAPH <urn:r:1> ; DROP SILENT GRAPH <urn:none> ; CREATE GRAPH <urn:new>", WHERE + "n_regionkey <> 1")
updated("sparql_update_copy", "COPY <urn:r:1> TO <urn:r:2>", WHERE + "n_regionkey <> 2 UNION ALL " + BASE_SQL.replace("CASE WHEN n_regionkey > 0 THEN '<urn:r:' || n_regionkey || '>' END", "'<urn:r:2>'") + " WHERE n_regionkey = 1")
updated("sparql_update_move", "MOVE GRAPH <urn:r:1> TO DEFAULT", WHERE + "n_regionkey > 1 UNION ALL " + BASE_SQL.replace("CASE WHEN n_regionkey > 0 THEN '<urn:r:' || n_regionkey || '>' END", "CAST(NULL AS VARCHAR)") + " WHERE n_regionkey = 1")
updated("sparql_update_add", "ADD DEFAULT TO <urn:r:4>", BASE_SQL + " UNION ALL " + BASE_SQL.replace("CASE WHEN n_regionkey > 0 THEN '<urn:r:' || n_regionkey || '>' END", "'<urn:r:4>'") + " WHERE n_regionkey = 0")


# -- Datalog
def texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)))


@register("SELECT CAST(c_custkey AS VARCHAR) AS c0, CAST(n_regionkey AS VARCHAR) AS c1 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def datalog_join(spark, sf_dir):
    return datalog(spark, "in(C, R) :- lives(C, N), part(N, R).", {"lives": texts(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey"), "part": texts(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")}, "in", 2)


@register("SELECT CAST(c_custkey AS VARCHAR) AS c0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def datalog_negation(spark, sf_dir):
    return datalog(spark, "idle(C) :- cust(C), not ordered(_, C).", {"cust": texts(table(spark, sf_dir, "customer"), "c_custkey"), "ordered": texts(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")}, "idle", 1)


#: Nations that follow each other by number within a region, in a ring.
RING = "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 5) % 25 AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) "


def ring(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("c0"), ((F.col("n_nationkey") + 5) % 25).cast("string").alias("c1"))


@register(RING + "SELECT CAST(a AS VARCHAR) AS c0, CAST(b AS VARCHAR) AS c1 FROM r")
def datalog_recursion(spark, sf_dir):
    return datalog(spark, "reach(X, Y) :- next(X, Y). reach(X, Z) :- reach(X, Y), next(Y, Z).", {"next": ring(spark, sf_dir)}, "reach", 2)


@register("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 5) % 25 AS b FROM nation), r AS (SELECT a, b, 1 AS odd FROM e UNION SELECT r.a, e.b, 1 - odd FROM r JOIN e ON r.b = e.a) SELECT CAST(a AS VARCHAR) AS c0, CAST(b AS VARCHAR) AS c1 FROM r WHERE odd = 0")
def datalog_mutual(spark, sf_dir):
    return datalog(spark, "odd(X, Y) :- next(X, Y). odd(X, Z) :- even(X, Y), next(Y, Z). even(X, Z) :- odd(X, Y), next(Y, Z).", {"next": ring(spark, sf_dir)}, "even", 2)


@register("SELECT CAST(a.n_nationkey AS VARCHAR) AS c0, CAST(b.n_nationkey AS VARCHAR) AS c1 FROM nation a, nation b WHERE a.n_nationkey % 5 <> b.n_nationkey % 5")
def datalog_strata(spark, sf_dir):
    return datalog(spark, "reach(X, Y) :- next(X, Y). reach(X, Z) :- reach(X, Y), next(Y, Z). node(X) :- next(X, _). apart(X, Y) :- node(X), node(Y), not reach(X, Y).", {"next": ring(spark, sf_dir)}, "apart", 2)


@register("SELECT 'a' AS c0, '\"a\"' AS c1 UNION ALL SELECT 'b', 'b'")
def datalog_constants(spark, sf_dir):
    return datalog(spark, 'p(a, "a"). p(b, b). go(). q(X, Y) :- p(X, Y), go().', {}, "q", 2)


# -- ShEx
def shex(name: str, shape: str, sql: str, tables: str = "customer nation", focus: str = "customer") -> None:
    def run(spark, sf_dir):
        facts = mapped(spark, sf_dir, *tables.split()).quads().select("s", "p", "o")
        nodes = facts.where(F.startswith("s", F.lit(f"<urn:t:{focus}:"))).select(F.col("s").alias("node")).distinct()
        return validate(facts, nodes, "PREFIX t: <urn:t:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + shape, "<urn:S>").select(T.iri_text(F.col("node")).alias("node"), "conforms")

    run.__name__ = name
    register(sql)(run)


C = "SELECT 'urn:t:customer:' || c_custkey AS node, {} AS conforms FROM customer"
shex("shex_nodekind", "<urn:S> { t:c_nationkey IRI ; t:c_name LITERAL }", C.format("c_nationkey IS NOT NULL AND c_name IS NOT NULL"))
shex("shex_datatype", "<urn:S> { t:c_custkey xsd:integer ; t:c_name xsd:string }", C.format("c_name IS NOT NULL"))
shex("shex_valueset", "<urn:S> { t:c_mktsegment ['BUILDING' 'MACHINERY'] }".replace("'", '"'), C.format("c_mktsegment IN ('BUILDING', 'MACHINERY')"))
shex("shex_cardinality", "<urn:S> { ^t:n_regionkey IRI {5,} }", "SELECT 'urn:t:region:' || r_regionkey AS node, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) >= 5 AS conforms FROM region", "nation region", "region")
shex("shex_closed", "<urn:S> CLOSED { t:n_name . ; t:n_regionkey IRI ; t:n_nationkey [1 2 3 4] ? }", "SELECT 'urn:t:nation:' || n_nationkey AS node, n_nationkey IN (1, 2, 3, 4) AS conforms FROM nation", "nation", "nation")
shex("shex_inverse", "<urn:S> { ^t:c_nationkey . + }", "SELECT 'urn:t:nation:' || n_nationkey AS node, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS conforms FROM nation", "customer nation", "nation")
shex("shex_oneof", '<urn:S> { t:c_mktsegment ["BUILDING"] | t:nothing . }', C.format("c_mktsegment = 'BUILDING'"))
shex("shex_reference", '<urn:S> { t:c_nationkey @<urn:N> } <urn:N> { t:n_regionkey [<urn:t:region:1> <urn:t:region:2>] }', "SELECT 'urn:t:customer:' || c_custkey AS node, n_regionkey IN (1, 2) AS conforms FROM customer JOIN nation ON c_nationkey = n_nationkey")
shex("shex_logic", '<urn:S> { t:c_mktsegment ["BUILDING"] } OR NOT { t:c_nationkey [<urn:t:nation:1>] }', C.format("c_mktsegment = 'BUILDING' OR c_nationkey <> 1"))


# -- documents


def rdf_docs(spark, sf_dir) -> DataFrame:
    """A Turtle document of a few lines for each customer."""
    k = K()
    text = F.concat(F.lit("@prefix z: <urn:z:> .\n@prefix c: <urn:c:> .\nc:"), k, F.lit(' z:name "'), F.col("c_name"), F.lit('" .\nc:'), k, F.lit(" foaf:nick c:x .\n"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), k).alias("path"), F.lit("ttl").alias("lang"), text.alias("text"))


@register("SELECT 'd' || c_custkey AS path, 'c:' || c_custkey AS name, 'subject' AS kind, 2 AS line FROM customer")
def doc_symbols(spark, sf_dir):
    return D.symbols(rdf_docs(spark, sf_dir))


@register("SELECT 'd' || c_custkey AS path, 3 AS line, 0 AS delta_line, 3 + length(c_custkey::VARCHAR) AS delta_start, 9 AS length FROM customer")
def doc_tokens_delta(spark, sf_dir):
    """The predicate of the last statement, relative to its subject."""
    made = D.delta_encoded(D.semantic_tokens(rdf_docs(spark, sf_dir)))
    return made.where("line = 3 AND type = 0 AND length = 9 AND delta_line = 0").select("path", "line", "delta_line", "delta_start", "length")


# Of each token its place, length, type and modifiers; k and n: to which the length of the key or of the name is added.
@register("""SELECT 'd' || c_custkey AS path, l AS line, dl AS delta_line, ds + CASE kd WHEN 'k' THEN length(c_custkey::VARCHAR) WHEN 'n' THEN length(c_name) ELSE 0 END AS delta_start,
  n + CASE kn WHEN 'k' THEN length(c_custkey::VARCHAR) WHEN 'n' THEN length(c_name) ELSE 0 END AS length, t AS type, m AS modifiers
FROM customer, (VALUES
  (0, 0, 0, '', 7, '', 6, 0), (0, 0, 8, '', 2, '', 0, 0), (0, 0, 3, '', 8, '', 2, 0),
  (1, 1, 0, '', 7, '', 6, 0), (1, 0, 8, '', 2, '', 0, 0), (1, 0, 3, '', 8, '', 2, 0),
  (2, 1, 0, '', 2, 'k', 0, 0), (2, 0, 3, 'k', 6, '', 0, 0), (2, 0, 7, '', 2, 'n', 4, 1),
  (3, 1, 0, '', 2, 'k', 0, 0), (3, 0, 3, 'k', 9, '', 0, 0), (3, 0, 10, '', 3, '', 0, 0)) v(l, dl, ds, kd, n, kn, t, m)""")
def doc_tokens_all(spark, sf_dir):
    """All tokens of the documents, each relative to the one before."""
    return D.delta_encoded(D.semantic_tokens(rdf_docs(spark, sf_dir))).drop("start")


@register("SELECT 'd' || c_custkey AS path, l AS line, CASE l WHEN 1 THEN 8 WHEN 3 THEN 13 + length(c_custkey::VARCHAR) ELSE 0 END AS start, 'cc' AS new_text FROM customer, (VALUES (1), (2), (3)) v(l) UNION ALL SELECT 'd' || c_custkey, 3, 0, 'cc' FROM customer")
def doc_rename(spark, sf_dir):
    return D.rename(rdf_docs(spark, sf_dir), "c", "cc").select("path", "line", "start", "new_text")


@register("SELECT 'd' || c_custkey AS path, n AS n, CASE n WHEN 0 THEN '@prefix c: <urn:c:> .' ELSE '@prefix z: <urn:z:> .' END AS text FROM customer, (VALUES (0), (1)) v(n)")
def doc_sort_prefixes(spark, sf_dir):
    return D.sorted_prefixes(rdf_docs(spark, sf_dir))


@register("SELECT 'd' || c_custkey AS path, 'foaf' AS prefix, '@prefix foaf: <http://xmlns.com/foaf/0.1/> .' AS text FROM customer")
def doc_missing_prefixes(spark, sf_dir):
    return D.missing_prefixes(rdf_docs(spark, sf_dir))


@register("SELECT 'd' || c_custkey AS path, 'c' AS prefix, 1 AS line FROM customer")
def doc_goto_prefix(spark, sf_dir):
    docs = rdf_docs(spark, sf_dir)
    return D.goto_prefix(docs, docs.select("path", F.lit("c").alias("prefix")))


@register("SELECT n_name AS token, 'urn:v#' || n_name AS iri, 'label ' || n_nationkey AS label FROM nation UNION ALL SELECT 'urn:v#' || n_name, 'urn:v#' || n_name, 'label ' || n_nationkey FROM nation")
def vocab_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    vocabulary = n.select(F.concat(F.lit("urn:v#"), F.col("n_name")).alias("iri"), F.concat(F.lit("label "), F.col("n_nationkey").cast("string")).alias("label"), F.lit("").alias("description"))
    tokens = n.select(F.col("n_name").alias("token")).union(n.select(F.concat(F.lit("<urn:v#"), F.col("n_name"), F.lit(">"))))
    return D.lookup(tokens, vocabulary).select(F.regexp_replace("token", "[<>]", "").alias("token"), "iri", "label")


@register("SELECT 'd' || c_custkey AS path, 'error' AS severity FROM customer WHERE c_custkey % 2 = 0")
def doc_diagnostics(spark, sf_dir):
    docs = rdf_docs(spark, sf_dir).select("path", "lang", F.when(F.col("path").rlike("[02468]$"), F.col("text")).otherwise(F.replace("text", F.lit("foaf:nick"), F.lit("z:nick"))).alias("content"))
    return D.diagnostics(reader.check(docs)).select("path", "severity")


@register("SELECT doc_id AS path, length(text) - length(replace(text, chr(10), '')) AS line FROM documents")
def doc_position(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("path"), D.position(F.col("text"), F.length("text"))["line"].alias("line"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region, counted."""
    text = "SELECT ?rname (COUNT(?n) AS ?c) WHERE { ?n <urn:t:n_regionkey> ?r . ?r <urn:t:r_name> ?rname } GROUP BY ?rname ORDER BY ?rname"
    return decoded(Engine(spark, mapped(spark, sf_dir, "nation", "region")).query(text), rname="text", c="long")


register("SELECT r_name AS rname, count(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")(flagship)
__all__ = ["QUERIES", "SQL", "Facts", "flagship"]
