"""Analysis of source texts: tables of (path, lang, text) to tables of what an editor asks for.

Lines and columns count from 0. Columns of tokens and edits are UTF-16 units, as editors count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

#: Namespaces that a missing prefix can be filled in from.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#", "skos": "http://www.w3.org/2004/02/skos/core#", "sh": "http://www.w3.org/ns/shacl#",
    "dcterms": "http://purl.org/dc/terms/", "dc": "http://purl.org/dc/elements/1.1/", "foaf": "http://xmlns.com/foaf/0.1/", "schema": "https://schema.org/",
    "prov": "http://www.w3.org/ns/prov#", "dcat": "http://www.w3.org/ns/dcat#", "ex": "http://example.org/",
}
#: The types of semantic tokens, by number.
TOKEN_TYPES = ["namespace", "type", "property", "variable", "string", "number", "keyword", "comment", "operator"]
DECLARES = r"(?i)^\s*(?:@prefix|prefix)\s+([A-Za-z][A-Za-z0-9_.\-]*|):\s*<([^>]*)>"


def lines(docs: DataFrame) -> DataFrame:
    """path, lang, line (number), text (of the line)."""
    return docs.select("path", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def diagnostics(outcomes: DataFrame) -> DataFrame:
    """path, severity, message, line, column of parse outcomes; all at the start of the document."""
    errors = outcomes.select("path", F.when(F.col("accepted"), "warning").otherwise("error").alias("severity"), F.explode(F.when(F.col("accepted"), F.col("warnings")).otherwise(F.concat("errors", "warnings"))).alias("message"))
    return errors.select("path", "severity", "message", F.lit(0).alias("line"), F.lit(0).alias("column"))


def is_fatal(found: DataFrame) -> DataFrame:
    """path, fatal: whether a document has an error among its diagnostics."""
    return found.groupBy("path").agg(F.max((F.col("severity") == "error").cast("int")).cast("boolean").alias("fatal"))


def render(severity: Column, code: Column, message: Column, path: Column, line_text: Column, line: Column, start: Column, end: Column) -> Column:
    """A diagnostic with its line and a row of carets below it; line and byte columns from 0."""
    number = (line + 1).cast("string")
    gutter = F.repeat(F.lit(" "), F.length(number))
    carets = F.concat(F.repeat(F.lit(" "), start), F.repeat(F.lit("^"), F.greatest(end - start, F.lit(1))))
    return F.concat(severity, F.lit("["), code, F.lit("]: "), message, F.lit("\n"), gutter, F.lit("--> "), path, F.lit(":"), number, F.lit(":"), (start + 1).cast("string"), F.lit("\n"), gutter, F.lit(" |\n"), number, F.lit(" | "), line_text, F.lit("\n"), gutter, F.lit(" | "), carets)


def lookup(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, iri, label, description: by the exact IRI, else by the bare local name (the first of equal ones).

    vocabulary: iri, label, description.
    """
    bare = F.regexp_replace("token", "^<|>$", "")
    own = tokens.select("token", bare.alias("bare"))
    exact = own.join(vocabulary, F.col("bare") == F.col("iri"))
    local = vocabulary.withColumn("local", F.regexp_extract("iri", "[^#/]*$", 0)).groupBy("local").agg(F.min(F.struct("iri", "label", "description")).alias("v"))
    rest = own.join(exact.select("token"), "token", "left_anti").join(local, F.col("bare") == F.col("local")).select("token", "v.iri", "v.label", "v.description")
    return exact.select("token", "iri", "label", "description").union(rest)


def position(text: Column, offset: Column) -> Column:
    """The line and the UTF-16 column of an offset in characters."""
    head = F.substring(text, F.lit(1), offset)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    tail = F.regexp_extract(head, r"[^\n]*\z", 0)
    return F.struct(line.alias("line"), utf16(tail).alias("column"))


def utf16(text: Column) -> Column:
    """Characters beyond the first plane take two units, and four bytes of UTF-8."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def token_at(text: Column, offset: Column) -> Column:
    """The word around an offset in characters."""
    left = F.regexp_extract(F.substring(text, F.lit(1), offset), r"[^\s;,()\[\]{}]*$", 0)
    right = F.regexp_extract(F.substring(text, offset + 1, F.length(text)), r"^[^\s;,()\[\]{}]*", 0)
    return F.regexp_replace(F.concat(left, right), r"\.$", "")


#: The words that are offered, by language, and the terms of rdf: beside those of Turtle and its kin.
TURTLE_WORDS = ["@prefix", "@base", "a", "true", "false"]
RDF_TERMS = ["type", "Property", "List", "nil", "first", "rest", "value", "Bag", "Seq", "Alt"]
COMPLETIONS = {
    "ttl": TURTLE_WORDS, "trig": TURTLE_WORDS, "n3": TURTLE_WORDS,
    "sparql": ["SELECT", "WHERE", "FILTER", "OPTIONAL", "UNION", "PREFIX", "BASE", "ASK", "CONSTRUCT", "DESCRIBE", "INSERT", "DELETE", "LIMIT", "OFFSET", "ORDER BY", "GROUP BY"],
    "shex": ["IRI", "LITERAL", "BNODE", "NONLITERAL", "AND", "OR", "NOT"],
}


def completions(docs: DataFrame) -> DataFrame:
    """path, n (their order), label, kind (keyword or value), detail, iri: what is offered in a document, wherever in it."""
    word = lambda label: F.struct(F.lit(label).alias("label"), F.lit("keyword").alias("kind"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("iri"))
    value = lambda name: F.struct(F.lit(f"rdf:{name}").alias("label"), F.lit("value").alias("kind"), F.lit("rdf:").alias("detail"), F.lit(NAMESPACES["rdf"] + name).alias("iri"))
    offered = {lang: [*map(word, words), *(map(value, RDF_TERMS) if words is TURTLE_WORDS else [])] for lang, words in COMPLETIONS.items()}
    pairs = F.create_map(*(x for lang, items in offered.items() for x in (F.lit(lang), F.array(*items))))
    return docs.select("path", F.posexplode(F.try_element_at(pairs, F.col("lang"))).alias("n", "item")).select("path", "n", "item.*")


def goto_prefix(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, prefix, line: where a prefix is first declared; in Turtle, TriG and Notation3 alone."""
    found = lines(docs).where(F.col("lang").isin("ttl", "trig", "n3") & F.col("text").rlike(r"^\s*(?:@prefix|(?i:prefix))\s")).select("path", F.regexp_extract("text", DECLARES, 1).alias("prefix"), "line")
    return found.join(wanted, ["path", "prefix"]).groupBy("path", "prefix").agg(F.min("line").alias("line"))


def symbols(docs: DataFrame) -> DataFrame:
    """path, name, kind, line: subjects, variables, shapes and heads, each where it first stands."""
    own = lines(docs)
    subject = own.where(F.col("lang").isin("ttl", "trig", "n3", "nt", "nq")).select("path", F.regexp_extract("text", r"^(<[^>]*>|_:[A-Za-z0-9_]+|[A-Za-z][A-Za-z0-9_.\-]*:[A-Za-z0-9_.\-]*|:[A-Za-z0-9_.\-]+)\s", 1).alias("name"), F.lit("subject").alias("kind"), "line")
    # A word that begins with a question mark, less what hangs on it; a line that begins with an IRI and opens a shape; what stands before a rule's first parenthesis.
    bare = F.transform(F.regexp_extract_all("text", F.lit(r"(?:^|\s)\?(\S+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""))
    variable = own.where("lang = 'sparql'").select("path", F.explode(bare).alias("name"), F.lit("variable").alias("kind"), "line").where("name <> ''").withColumn("name", F.concat(F.lit("?"), F.col("name")))
    shape = own.where("lang = 'shex'").where(F.contains("text", F.lit("{"))).select("path", F.regexp_extract("text", r"^\s*<([^>]+)>", 1).alias("name"), F.lit("shape").alias("kind"), "line")
    rule = F.substring_index("text", ":-", 1)
    head = own.where("lang = 'datalog'").where(~F.col("text").rlike(r"^\s*[%#]")).select("path", F.regexp_extract(rule, r"^\s*([A-Za-z0-9_]+)\s*\(", 1).alias("name"), F.lit("relation").alias("kind"), "line")
    every = subject.union(variable).union(shape).union(head).where("name <> ''")
    return every.groupBy("path", "name", "kind").agg(F.min("line").alias("line"))


#: The words that are keywords in queries, in any case, and in schemas as they stand.
SPARQL_WORDS = """
SELECT WHERE FILTER OPTIONAL UNION GRAPH FROM ASK CONSTRUCT DESCRIBE LIMIT OFFSET ORDER BY GROUP HAVING PREFIX BASE BIND VALUES INSERT DELETE LOAD CLEAR DROP
CREATE WITH MINUS SERVICE SILENT NAMED USING DEFAULT ALL DISTINCT REDUCED AS IN NOT EXISTS STR LANG DATATYPE IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT
STRLEN UCASE LCASE ENCODE_FOR_URI CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1
SHA256 SHA384 SHA512 COALESCE IF STRLANG STRDT SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC REGEX SUBSTR REPLACE COUNT SUM MIN MAX AVG SAMPLE
GROUP_CONCAT SEPARATOR
"""
SHEX_WORDS = "PREFIX BASE START CLOSED EXTENDS AND OR NOT IRI LITERAL NONLITERAL BNODE ABSTRACT EXTRA"
#: What is coloured in a line, where a string or an IRI ends with its line at the latest.
SPAN = r"(?P<string>\"(?:\\[^\n]?|[^\"\\\n])*\"?)"
COLOURED_IRI = r"(?P<property><[^>\n]*>?"
SCANNERS = {
    "ttl": r"(?P<comment>\#[^\r\n]*)|(?P<string>\"(?:\\[^\n]?|[^\"\\\n])*\"?|'(?:\\[^\n]?|[^'\\\n])*'?)|(?P<keyword>@[A-Za-z]*|(?:a|true|false)(?![A-Za-z0-9_:\-]))|(?P<namespace>[A-Za-z0-9_][A-Za-z0-9_\-]*:[A-Za-z0-9_:\-]*)|(?P<property><[^>\n]*>?|[A-Za-z0-9_][A-Za-z0-9_\-]*)",
    "nt": r"(?P<comment>(?m:^[^\S\n]*)\#[^\r\n]*|\#[^\r\n]*)|(?P<string>\"(?:\\[^\n]?|[^\"\\\n])*\"?|'(?:\\[^\n]?|[^'\\\n])*'?)|(?P<keyword>@[A-Za-z]*|(?:a|true|false)(?![A-Za-z0-9_:\-]))|(?P<namespace>[A-Za-z0-9_][A-Za-z0-9_\-]*:[A-Za-z0-9_:\-]*)|(?P<property><[^>\n]*>?|[A-Za-z0-9_][A-Za-z0-9_\-]*)",
    "sparql": rf"(?P<comment>\#[^\r\n]*)|{SPAN}|(?P<variable>[?$][A-Za-z0-9_]*)|(?P<keyword>(?i:{'|'.join(SPARQL_WORDS.split())})(?![A-Za-z0-9_:]))|(?P<namespace>[A-Za-z][A-Za-z0-9_]*:[A-Za-z0-9_:]*)|{COLOURED_IRI}|[A-Za-z][A-Za-z0-9_]*)|(?P<number>[0-9][0-9.eE+\-]*)",
    "shex": rf"(?P<comment>\#[^\r\n]*)|{SPAN}|(?P<keyword>@[A-Za-z]*|(?:{'|'.join(SHEX_WORDS.split())})(?![A-Za-z0-9_:\-]))|(?P<namespace>[A-Za-z][A-Za-z0-9_\-]*:[A-Za-z0-9_:\-]*)|{COLOURED_IRI}|[A-Za-z][A-Za-z0-9_\-]*)",
    "datalog": rf"(?P<comment>(?m:^[^\S\n]*)%[^\r\n]*|%[^\r\n]*)|{SPAN}|(?P<variable>[A-Z][A-Za-z0-9_]*)|(?P<keyword>not)|(?P<property>[a-z][A-Za-z0-9_]*)",
}
#: The same words without their kinds, which are found much faster; a word's kind is asked for once.
WORD = r"|\"(?:\\[^\n]?|[^\"\\\n])*\"?|<[^>\n]*>?"
QUOTE = r"|'(?:\\[^\n]?|[^'\\\n])*'?|@[A-Za-z]*"
PLAIN = {
    "ttl": rf"[A-Za-z0-9_][A-Za-z0-9_:\-]*{WORD}{QUOTE}|\#[^\r\n]*", "nt": rf"[A-Za-z0-9_][A-Za-z0-9_:\-]*{WORD}{QUOTE}|(?m:^[^\S\n]*)\#[^\r\n]*|\#[^\r\n]*",
    "sparql": rf"[A-Za-z][A-Za-z0-9_:]*|[?$][A-Za-z0-9_]*{WORD}|[0-9][0-9.eE+\-]*|\#[^\r\n]*", "shex": rf"[A-Za-z][A-Za-z0-9_:\-]*{WORD}|@[A-Za-z]*|\#[^\r\n]*",
    "datalog": r"not|[A-Za-z][A-Za-z0-9_]*|\"(?:\\[^\n]?|[^\"\\\n])*\"?|(?m:^[^\S\n]*)%[^\r\n]*|%[^\r\n]*",
}
#: What is told apart for edits, where strings are those of the language.
LEXERS = {
    "ttl": SCANNERS["ttl"], "nt": SCANNERS["nt"],
    "sparql": r"(?P<comment>\#[^\n]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<type><[^>\s]*>)|(?P<variable>[?$]\w+)|(?P<property>(?:[A-Za-z][\w.\-]*)?:[\w\-]+)|(?P<namespace>[A-Za-z][\w.\-]*:)|(?P<keyword>\b[A-Za-z_]+\b)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<operator>\^\^|&&|\|\||!=|<=|>=|[.;,|/^=<>!*+?\-(){}\[\]])",
    "shex": r"(?P<comment>\#[^\n]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\")|(?P<type><[^>\s]*>)|(?P<property>(?:[A-Za-z][\w.\-]*)?:[\w\-]+)|(?P<namespace>[A-Za-z][\w.\-]*:)|(?P<keyword>\b[A-Za-z_]+\b)|(?P<number>\d+)|(?P<operator>[.;,|^=@&$*+?!~\-(){}\[\]])",
    "datalog": r"(?P<comment>%[^\n]*|\#[^\n]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\")|(?P<keyword>\bnot\b)|(?P<variable>\b[A-Z_]\w*)|(?P<property>\b[a-z]\w*)|(?P<number>\d+)|(?P<operator>:-|[(),.!])",
}
SAME = {"trig": "ttl", "n3": "ttl", "nq": "nt"}
#: Whose tokens have the first modifier.
MODIFIED = "string"


def _compiled(scanners: dict[str, str]) -> dict[str, tuple[re.Pattern, np.ndarray, np.ndarray]]:
    """For each language its scanner and, by number of group, the type and the modifiers of what it finds."""
    out = {}
    for lang, pattern in scanners.items():
        scanner = re.compile(pattern, re.S)
        names = [None, *sorted(scanner.groupindex, key=scanner.groupindex.get)]
        out[lang] = scanner, np.array([TOKEN_TYPES.index(n) if n else 0 for n in names], dtype=np.int32), np.array([int(n == MODIFIED) for n in names], dtype=np.int32)
    return out


def scan(text: str, scanner: re.Pattern, plain: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """line, start, length, group and offset (in characters) of each token; those of several lines count to the end of their first."""
    _, line, start, length, group, places = scan_all([text], scanner, plain)[:6]
    return line, start, length, group, places


def scan_all(texts: list[str], scanner: re.Pattern, plain: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """The same of many texts, with the number of each token's text before and the texts in one, to which the offsets are, after.

    Only matches are told one by one; lines and UTF-16 columns come from the places of line feeds and of wide characters in all texts together.
    """
    matches, counts = [], []
    for text in texts:
        own = list((plain or scanner).finditer(text))
        matches += own
        counts.append(len(own))
    numbers = lambda values: np.fromiter(values, dtype=np.int64, count=len(matches))
    whose = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bases = np.cumsum(sizes + 1) - sizes - 1
    begins, ends = numbers(map(re.Match.start, matches)) + bases[whose], numbers(map(re.Match.end, matches)) + bases[whose]
    if plain is None:
        group = numbers(map(attrgetter("lastindex"), matches))
    else:
        words = list(map(re.Match.group, matches))
        kinds = {w: scanner.match(w).lastindex for w in set(words)}
        group = numbers(map(kinds.__getitem__, words))
    whole = "\n".join(texts)  # the line feed between two ends the last line of the first
    if whole.isascii():
        feeds, wide = np.flatnonzero(np.frombuffer(whole.encode(), dtype=np.uint8) == 10), None
    else:
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        feeds, wide = np.flatnonzero(points == 10), np.concatenate([[0], np.cumsum(points > 0xFFFF)])
    line = np.searchsorted(feeds, begins)
    ends = np.minimum(ends, np.append(feeds, len(whole))[line])
    starts = np.concatenate([[0], feeds + 1])[line]
    start, length = begins - starts, ends - begins
    if wide is not None:
        start, length = start + wide[begins] - wide[starts], length + wide[ends] - wide[begins]
    return whose, line - np.searchsorted(feeds, bases)[whose], start, length, group, np.stack([begins, ends]), whole


#: What is gathered before a batch goes out: documents, and characters of their texts.
DOCUMENTS, CHARACTERS = 1000, 1 << 20


def _scanned(kind: str):
    """kind: plain, text (with what stands there) or delta (with places relative to the token before)."""
    names = ["path", "line", "start", "length", "type", "modifiers", *{"plain": [], "text": ["text"], "delta": ["delta_line", "delta_start"]}[kind]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(LEXERS if kind == "text" else SCANNERS)
        plain = {} if kind == "text" else {lang: re.compile(p) for lang, p in PLAIN.items()}

        def gathered(lang: str, made: list[tuple[str, str]]) -> pa.RecordBatch:
            """Tokens of many documents of one language as one batch."""
            scanner, types, modifiers = compiled[lang]
            paths, texts = zip(*made, strict=True)
            whose, line, start, length, group, places, whole = scan_all(list(texts), scanner, plain.get(lang))
            columns = [line, start, length, types[group], modifiers[group]]
            if kind == "delta":
                first = np.flatnonzero(np.diff(whose, prepend=-1))
                down, right = np.diff(line, prepend=0), np.diff(start, prepend=0)
                down[first], right[first] = line[first], start[first]
                columns += [down, np.where(down == 0, right, start)]
            arrays = [pa.DictionaryArray.from_arrays(pa.array(whose), pa.array(paths, pa.string())).cast(pa.string()), *(pa.array(c.astype(np.int32)) for c in columns)]
            if kind == "text":
                arrays.insert(6, pa.array([whole[a:b] for a, b in places.T.tolist()], pa.string()))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        made: dict[str, list[tuple[str, str]]] = {}
        count = held = 0
        for batch in batches:
            for path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lang = SAME.get(lang, lang)
                if text is None or lang not in compiled:
                    continue
                made.setdefault(lang, []).append((path, text))
                count, held = count + 1, held + len(text)
                if count >= DOCUMENTS or held >= CHARACTERS:
                    yield from (gathered(*x) for x in made.items())
                    made, count, held = {}, 0, 0
        yield from (gathered(*x) for x in made.items())

    return run


PLACES = "path string, line int, start int, length int, type int, modifiers int"


def tokens(docs: DataFrame) -> DataFrame:
    """path, line, start, length, type (a number of TOKEN_TYPES), modifiers, text (of the first line): words as the language has them, for edits."""
    return dealt(docs.select("path", "lang", "text"), "path", "text").mapInArrow(_scanned("text"), PLACES + ", text string")


def semantic_tokens(docs: DataFrame) -> DataFrame:
    """path, line, start, length, type (a number of TOKEN_TYPES), modifiers: what is coloured in each line."""
    return dealt(docs.select("path", "lang", "text"), "path", "text").mapInArrow(_scanned("plain"), PLACES)


def delta_tokens(docs: DataFrame) -> DataFrame:
    """path, line, start, delta_line, delta_start, length, type, modifiers: each place relative to the token before, as the scan comes by it."""
    made = dealt(docs.select("path", "lang", "text"), "path", "text").mapInArrow(_scanned("delta"), PLACES + ", delta_line int, delta_start int")
    return made.select("path", "line", "start", "delta_line", "delta_start", "length", "type", "modifiers")


def delta_encoded(tokens: DataFrame) -> DataFrame:
    """Tokens of any table relative to the one before in their document."""
    w = Window.partitionBy("path").orderBy("line", "start")
    line = F.col("line") - F.coalesce(F.lag("line").over(w), F.lit(0))
    start = F.when(line == 0, F.col("start") - F.coalesce(F.lag("start").over(w), F.lit(0))).otherwise(F.col("start"))
    return tokens.select("path", "line", "start", line.alias("delta_line"), start.alias("delta_start"), "length", "type", "modifiers")


def rename(docs: DataFrame, old: str, new: str, variable: bool = False) -> DataFrame:
    """path, line, start, end, new_text: the edits that rename a prefix, or a variable; what stands in strings, comments and IRIs stays."""
    text = F.col("text")
    own = text.isin(f"?{old}", f"${old}") if variable else F.startswith(text, F.lit(f"{old}:"))
    inert = F.col("type").isin(TOKEN_TYPES.index("string"), TOKEN_TYPES.index("comment")) | F.startswith(text, F.lit("<"))
    start = F.col("start") + (1 if variable else 0)
    return tokens(docs).where(own & ~inert).select("path", "line", start.alias("start"), (start + len(old)).alias("end"), F.lit(new).alias("new_text"))


def sorted_prefixes(docs: DataFrame) -> DataFrame:
    """path, n, text: the prefix declarations of each document in order of their names."""
    found = lines(docs).where(F.col("text").rlike(DECLARES)).select("path", F.regexp_extract("text", DECLARES, 1).alias("prefix"), "line", "text")
    return found.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("prefix", "line")) - 1).alias("n"), "text")


def used_prefixes(docs: DataFrame) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"<[^>\s]*>", " "), r'"(?:[^"\\]|\\.)*"', " "), r"(?m)#.*$", " ")
    return docs.select("path", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_.\-:])([A-Za-z][A-Za-z0-9_\-]*):"), F.lit(1)))).alias("prefix"))


def missing_prefixes(docs: DataFrame) -> DataFrame:
    """path, prefix, text: declarations for prefixes that are used, known and not declared."""
    declared = lines(docs).where(F.col("text").rlike(DECLARES)).select("path", F.regexp_extract("text", DECLARES, 1).alias("prefix"))
    known = F.create_map(*(F.lit(x) for pair in NAMESPACES.items() for x in pair))
    missing = used_prefixes(docs).join(declared, ["path", "prefix"], "left_anti").withColumn("ns", F.try_element_at(known, F.col("prefix"))).where("ns IS NOT NULL")
    return missing.select("path", "prefix", F.concat(F.lit("@prefix "), F.col("prefix"), F.lit(": <"), F.col("ns"), F.lit("> .")).alias("text"))


def extract_prefix(iri: Column) -> Column:
    """prefix, namespace, local, replacement and declaration for an IRI in a known namespace, the first that fits; null for others."""
    found: Column | None = None
    for prefix, ns in NAMESPACES.items():
        local = F.substring(iri, F.lit(len(ns) + 1), F.length(iri))
        made = F.struct(F.lit(prefix).alias("prefix"), F.lit(ns).alias("namespace"), local.alias("local"), F.concat(F.lit(prefix + ":"), local).alias("replacement"), F.lit(f"@prefix {prefix}: <{ns}> .").alias("declaration"))
        found = F.when(F.startswith(iri, F.lit(ns)), made) if found is None else found.when(F.startswith(iri, F.lit(ns)), made)
    assert found is not None
    return F.when(found["local"] != "", found)


def statement_bounds(text: Column, offset: Column) -> Column:
    """The full stops before and after an offset: where a statement may begin and end."""
    head = F.substring(text, F.lit(1), offset)
    before = F.when(F.contains(head, F.lit(".")), F.length(head) - F.locate(".", F.reverse(head)) + 1).otherwise(0)
    after = F.locate(".", F.substring(text, offset + 1, F.length(text)))
    return F.struct(before.alias("start"), F.when(after > 0, offset + after).otherwise(F.length(text)).alias("end"))


def changed(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents whose text is not what was parsed before (path, hash)."""
    return docs.withColumn("hash", F.sha2("text", 256)).join(seen.select("path", "hash"), ["path", "hash"], "left_anti")
