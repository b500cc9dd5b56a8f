"""Documents of any of the languages as tables of facts and outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from ..functions import terms as T
from ..operators import facts as O
from ..plans.datalog import encode_datalog
from ..plans.shex import encode_shex
from ..plans.sparql_encode import encode_sparql
from ..plans.sparql_parser import fold_tag
from ..session import dealt, written
from .jsonld import parse_jsonld
from .rdf_text import Quad, parse_text
from .rdf_xml import parse_rdf_xml, parse_trix

#: File name extensions and the languages they mean.
EXTENSIONS = {
    "nt": "nt", "nq": "nq", "ttl": "ttl", "turtle": "ttl", "trig": "trig", "rdf": "rdfxml", "xml": "rdfxml", "jsonld": "jsonld", "json-ld": "jsonld",
    "trix": "trix", "n3": "n3", "sparql": "sparql", "rq": "sparql", "ru": "sparql", "shex": "shex", "dl": "datalog",
}


def language_of(path: Column) -> Column:
    """The language by extension, null where it is unknown."""
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    pairs = [x for e, lang in EXTENSIONS.items() for x in (F.lit(e), F.lit(lang))]
    return F.try_element_at(F.create_map(*pairs), extension)


def parse_document(content: bytes, lang: str, base: str | None) -> tuple[list[Quad], list[str]]:
    if lang in ("rdfxml", "trix", "jsonld"):
        return {"rdfxml": parse_rdf_xml, "jsonld": parse_jsonld}[lang](content, base) if lang != "trix" else parse_trix(content), []
    text = content.decode("utf-8")
    if lang in ("nt", "nq", "ttl", "trig", "n3"):
        return parse_text(text, lang, base)
    encode: dict[str, Callable[[str], list[Quad]]] = {"sparql": encode_sparql, "shex": encode_shex, "datalog": encode_datalog}
    return encode[lang](text), []


FACT = "struct<s:string,p:string,o:string,g:string,src_offset:bigint>"
CHECKED = "path string, lang string, accepted boolean, warnings array<string>, errors array<string>"
OUTCOME = f"{CHECKED}, facts array<{FACT}>"
ROW = pa.struct([("s", pa.string()), ("p", pa.string()), ("o", pa.string()), ("g", pa.string()), ("src_offset", pa.int64())])


#: What is gathered before a batch goes out: documents, and characters of their facts.
DOCUMENTS, CHARACTERS = 1000, 4 << 20


def _outcomes(made: list[tuple], with_facts: bool) -> pa.RecordBatch:
    """Outcomes of many documents, their facts in one array: a batch of its own for each would cost far more than small documents do."""
    path, lang, good, warnings, errors, facts = zip(*made, strict=True)
    columns = [(path, pa.string()), (lang, pa.string()), (good, pa.bool_()), (warnings, pa.list_(pa.string())), (errors, pa.list_(pa.string()))]
    names, arrays = ["path", "lang", "accepted", "warnings", "errors"], [pa.array(v, k) for v, k in columns]
    if not with_facts:
        return pa.RecordBatch.from_arrays(arrays, names=names)
    quads = [q for own in facts for q in own]
    sizes = np.fromiter(map(len, facts), dtype=np.int64, count=len(facts))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    offset = np.arange(len(quads)) - np.repeat(ends[:-1], sizes)
    rows = pa.StructArray.from_arrays([*(pa.array(c, pa.string()) for c in (zip(*quads, strict=True) if quads else [[]] * 4)), pa.array(offset, pa.int64())], fields=list(ROW))
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=[*names, "facts"])


def _parsed(batches: Iterator[pa.RecordBatch], with_facts: bool = True) -> Iterator[pa.RecordBatch]:
    made, held = [], 0
    for batch in batches:
        for path, lang, base, content in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            content = content.as_py()  # a large document is held by itself
            rows, warnings, errors, good = [], [], [], True
            try:
                rows, warnings = parse_document(content or b"", lang, base)
            except UnicodeDecodeError as e:
                good, errors = False, [f"{lang.upper()}-UTF8-001: {e}"]
            except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as e:
                good, errors = False, [str(e)]
            rows = rows if with_facts else []
            made.append((path, lang, good, warnings, errors, rows))
            held += len(path or "") + sum(map(len, errors)) + sum(map(len, filter(None, chain.from_iterable(rows))))
            if len(made) >= DOCUMENTS or held >= CHARACTERS:
                yield _outcomes(made, with_facts)
                made, held = [], 0
    if made:
        yield _outcomes(made, with_facts)


def _read(documents: DataFrame, deal: bool) -> DataFrame:
    lang = F.coalesce(F.col("lang"), language_of(F.col("path"))) if "lang" in documents.columns else language_of(F.col("path"))
    base = F.col("base") if "base" in documents.columns else F.lit(None).cast("string")
    own = documents.select("path", lang.alias("lang"), base.alias("base"), F.col("content").cast("binary").alias("content")).where("lang IS NOT NULL")
    return dealt(own, "path", "content") if deal else own


def parse(documents: DataFrame, deal: bool = True) -> DataFrame:
    """Outcomes of documents (path, content, and lang and base where they are not told by path), dealt to all tasks unless they are already."""
    return _read(documents, deal).mapInArrow(_parsed, OUTCOME)


def check(documents: DataFrame, deal: bool = True) -> DataFrame:
    """Outcomes without their facts: documents are parsed and encoded as a whole all the same, but what they say stays where it was made."""
    return _read(documents, deal).mapInArrow(partial(_parsed, with_facts=False), CHECKED)


PARSES_TO = "<urn:x-rdf-iri:parses-to>"


def parse_iris(documents: DataFrame) -> DataFrame:
    """Outcomes of IRIs (path, content), by column expressions: each is the fact of what it is when normalised."""
    text = F.decode(F.col("content").cast("binary"), "UTF-8")
    error = F.when(~I.is_absolute(text), "IRI-SYNTAX-001: a relative reference, where an absolute IRI is wanted").when(~I.is_valid(text), "IRI-SYNTAX-001: not an IRI").when(text.isNull(), "IRI-SYNTAX-001: nothing there")
    fact = F.struct(T.iri(text).alias("s"), F.lit(PARSES_TO).alias("p"), T.iri(I.normalise(text)).alias("o"), F.lit(None).cast("string").alias("g"), F.lit(0).cast("long").alias("src_offset"))
    none = F.array().cast("array<string>")
    rows = documents.select("path", F.lit("iri").alias("lang"), error.alias("error"), fact.alias("fact"))
    made = rows.select("path", "lang", F.col("error").isNull().alias("accepted"), none.alias("warnings"), F.when(F.col("error").isNull(), none).otherwise(F.array("error")).alias("errors"), "error", "fact")
    return made.select("path", "lang", "accepted", "warnings", "errors", F.when(F.col("accepted"), F.array("fact")).otherwise(F.array().cast(f"array<{FACT}>")).alias("facts"))


#: Documents of so many facts at most are canonicalised where they stand.
FACTS = 256


def facts_of(outcomes: DataFrame, canonical: bool = True) -> DataFrame:
    """doc_id, s, p, o, g, src_offset, parser of all accepted documents.

    A document's outcome is one row as a rule, which is made canonical by itself. Those of more facts, or of several rows, are merged; which these
    are is told first. Outcomes are written for that, so nothing is parsed again.
    """
    columns = ["path", "f.s", "f.p", "f.o", "f.g", "f.src_offset", "lang"]
    # The outer form, as Spark infers of the other that arrays aren't empty, and tells that by making them once more.
    exploded = lambda df: df.select("path", F.explode_outer("facts").alias("f"), "lang").where("f IS NOT NULL").select(*columns).toDF("doc_id", *O.QUAD, "src_offset", "parser")
    good = outcomes.where("accepted").select("path", "lang", "facts")
    if not canonical:
        return exploded(good)
    held = written(good.withColumns({"size": F.size("facts"), "key": F.xxhash64("path")}))
    odd = written(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where((F.col("n") > 1) | (F.col("size") > FACTS)).select("key"))
    alone, others = (held.join(odd, "key", how) for how in ("left_anti", "left_semi"))
    return exploded(O.canonicalise_rows(alone)).unionByName(O.canonicalise(exploded(others)))


def read_files(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """Outcomes of all files below a path whose extensions are known."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    docs = files.select("path", "content", F.lit(base).cast("string").alias("base"))
    return parse(docs)


ABSOLUTE = r"<[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|^`\\]*>"
NODE = rf"(?:{ABSOLUTE}|_:[A-Za-z0-9_]+)"
PLAIN = rf"\"[^\"\\\r\n]*\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{ABSOLUTE})?"
USUAL = {f: rf"^(?P<s>{NODE}) (?P<p>{ABSOLUTE}) (?P<o>{NODE}|{PLAIN})" + (rf"(?: (?P<g>{NODE}))?" if f == "nq" else "") + r" \.$" for f in ("nt", "nq")}
STRING = f"^^<{T.XSD}string>"
LINE = pa.schema([*((c, pa.string()) for c in ("doc_id", "s", "p", "o", "g")), ("src_offset", pa.int64()), ("error", pa.string())])


def canonical_objects(o: pa.Array) -> pa.Array:
    """Folded tags, and no explicit xsd:string; other terms are canonical as they stand."""
    o = pc.if_else(pc.ends_with(o, STRING), pc.replace_substring(o, STRING, "", max_replacements=1), o)
    tagged = pc.and_(pc.starts_with(o, '"'), pc.invert(pc.or_(pc.ends_with(o, '"'), pc.ends_with(o, ">"))))
    if not pc.any(tagged).as_py():
        return o
    folded = [head + "@" + fold_tag(tag) for head, _, tag in (x.rpartition("@") for x in o.filter(tagged).to_pylist())]
    return pc.replace_with_mask(o, tagged, pa.array(folded, pa.string()))


class Running:
    """Where each line of a split begins, counted from the split's first: lines come in the order of their files."""

    def __init__(self):
        self.place, self.at = None, 0

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        doc, block = batch.column(0), batch.column(1)
        ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begins = np.concatenate([[0], ends[:-1]])
        changes = pc.or_(pc.not_equal(doc.slice(1), doc.slice(0, len(doc) - 1)), pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)))
        first = np.concatenate([[0], 1 + np.flatnonzero(changes.to_numpy(zero_copy_only=False))])
        own = np.zeros(len(first), dtype=np.int64)
        own[1:] = begins[first[1:]]
        here, last = (doc[0].as_py(), block[0].as_py()), (doc[-1].as_py(), block[-1].as_py())
        own[0] = -self.at if here == self.place else 0
        self.place, self.at = last, int(ends[-1] - own[-1])
        return begins - np.repeat(own, np.diff([*first, len(begins)]))


def _lines(format: str, running: bool = False):
    """Lines in the usual form are taken apart all at once, the others by the parser. running: the second column is a line's split, which is kept."""
    schema = LINE.append(pa.field("block", pa.int64())) if running else LINE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Running()
        for batch in batches:
            if not batch.num_rows:
                continue
            block = [batch.column(1)] if running else []
            if running:
                line = batch.column(2)
                at = pa.array(place(batch))
                line = pc.replace_substring_regex(line, "\r+$", "") if pc.any(pc.ends_with(line, "\r")).as_py() else line
                batch = pa.RecordBatch.from_arrays([batch.column(0), at, line, *block], names=["doc_id", "src_offset", "line", "block"])
            line = batch.column(2)
            parts = pc.extract_regex(line, USUAL[format])
            usual = pc.is_valid(parts)
            found, own = parts.filter(usual), batch.filter(usual)
            none = pa.nulls(len(found), pa.string())
            g = found.field("g") if format == "nq" else none
            g = pc.if_else(pc.equal(g, ""), none, g) if format == "nq" else g
            yield pa.RecordBatch.from_arrays([own.column(0), found.field("s"), found.field("p"), canonical_objects(found.field("o")), g, own.column(1), none, *([own.column(3)] if running else [])], schema=schema)
            rest = batch.filter(pc.and_(pc.invert(usual), pc.invert(pc.fill_null(pc.match_substring_regex(line, r"^[ \t]*(?:#.*)?$"), True))))
            rows = []
            for path, offset, text, *kept in zip(*(c.to_pylist() for c in rest.columns), strict=True):
                try:
                    if text.startswith("\ufeff"):
                        raise ValueError("NT-BOM-001: byte order mark within a file")
                    rows += [(path, *q, offset, None, *kept) for q in parse_text(text, format)[0]]
                except ValueError as e:
                    rows.append((path, None, None, None, None, offset, str(e), *kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


#: Extensions of compressed files, of which the size says nothing of their text.
COMPRESSED = r"\.(?:gz|bz2|zst|lz4|snappy|deflate)$"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the split that they were read from; a split's lines begin where those of the one before it end."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"))


def line_places(spark: SparkSession, path: str) -> DataFrame:
    """Where the first line of each split stands in its file: doc_id, block, base, lines, bytes, marked. A row a split, written.

    Spark's reader skips a byte order mark that begins a file; what a file is longer than its lines tells of it.
    """
    splits = _text(spark, path).groupBy("doc_id", "block").agg(F.sum(F.octet_length("line") + F.lit(1).cast("long")).alias("bytes"), F.count(F.lit(1)).alias("lines"), F.max("size").alias("size"))
    file = Window.partitionBy("doc_id")
    before = F.coalesce(F.sum("bytes").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    marked = (F.col("size") - F.sum("bytes").over(file) >= 2) & ~F.col("doc_id").rlike(COMPRESSED)
    return written(splits.select("doc_id", "block", before.alias("before"), "lines", "bytes", marked.alias("marked")).select("doc_id", "block", (F.col("before") + F.when(F.col("marked"), 3).otherwise(0)).alias("base"), "lines", "bytes", "marked"))


def line_files(places: DataFrame) -> DataFrame:
    """doc_id, lines, warnings: a row for each file that has a line."""
    told = places.groupBy("doc_id").agg(F.sum("lines").alias("lines"), F.max("marked").alias("marked"))
    return told.select("doc_id", "lines", F.when(F.col("marked"), F.array(F.lit("ANY-BOM-001: byte order mark skipped"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def read_lines(spark: SparkSession, path: str, format: str = "nt", places: DataFrame | None = None, offsets: bool = True) -> DataFrame:
    """N-Triples or N-Quads files of any size: doc_id, s, p, o, g, src_offset, error (of lines that are none), parser.

    Splittable, from any store that Spark reads. src_offset is the byte of the file (of its text, where it is compressed) that the line begins at:
    each task counts within its splits, to which the lines of the splits before are added, told by a first pass over their lengths (places, if
    it has been made). Without offsets, which spares that pass, it is null. A byte order mark that begins a file is a warning
    (``line_files``); one that reaches a line stands within the file, and is its error. Lines end with a line feed, or one after a carriage return.
    """
    rows = _text(spark, path).drop("size")
    made = rows.mapInArrow(_lines(format, True), "doc_id string, s string, p string, o string, g string, src_offset long, error string, block long")
    if offsets:
        base = (line_places(spark, path) if places is None else places).select("doc_id", "block", "base")
        made = made.join(base, ["doc_id", "block"]).withColumn("src_offset", F.col("src_offset") + F.col("base"))
    else:
        made = made.withColumn("src_offset", F.lit(None).cast("long"))
    return made.select("doc_id", "s", "p", "o", "g", "src_offset", "error", F.lit(format).alias("parser"))


def line_facts(text: DataFrame, format: str = "nt") -> DataFrame:
    """The facts of lines (doc_id, src_offset, line), of a table or of a stream."""
    made = text.select("doc_id", "src_offset", "line").mapInArrow(_lines(format), "doc_id string, s string, p string, o string, g string, src_offset long, error string")
    return made.withColumn("parser", F.lit(format))


# -- oracle files and W3C manifests


def read_oracle(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case of oracle JSON files, with what the file says of its parser."""
    schema = "schema_version string, lang string, parser string, parser_version string, suite_commit string, generated_at_utc string, cases array<struct<id:string,input_path:string,input_sha256:string,accepted:boolean,error_class:string,error_message:string,facts:array<string>,fact_count:bigint>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("schema_version", "lang", "parser", "parser_version", "suite_commit", "generated_at_utc", F.explode("cases").alias("c")).select("lang", "parser", "parser_version", "c.*")


MF = "http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#"
KINDS = ["PositiveSyntax", "NegativeSyntax", "NegativeEval", "Eval"]


def manifest_entries(facts: DataFrame) -> DataFrame:
    """doc_id, name, kind, action, result of the entries of manifests, by joins of their facts."""
    of = lambda p, name: facts.where(F.col("p") == f"<{p}>").select("doc_id", "s", F.col("o").alias(name))
    types = of("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "type")
    kind = F.coalesce(*(F.when(F.col("type").rlike(k), F.lit(k)) for k in KINDS), F.when(F.col("type").rlike(r"#Positive.*SyntaxTest11"), F.lit("PositiveSyntax")), F.when(F.col("type").rlike(r"#Negative.*SyntaxTest11"), F.lit("NegativeSyntax")))
    made = types.withColumn("kind", kind).where("kind IS NOT NULL").join(of(MF + "action", "action"), ["doc_id", "s"]).join(of(MF + "result", "result"), ["doc_id", "s"], "left").join(of(MF + "name", "name"), ["doc_id", "s"], "left")
    return made.select("doc_id", F.coalesce(T.lexical(F.col("name")), F.col("s")).alias("name"), "kind", T.iri_text(F.col("action")).alias("action"), T.iri_text(F.col("result")).alias("result"))


#: What a language's report holds beside its entries, in order.
REPORT = ["language", "corpora_count", "oracles_count", "manifests_count", "tests_executed", "pass", "divergences", "skipped", "allowlisted", "fail_gate", "clean"]


def reports(verdicts: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """lang, report (JSON): a report of each language.

    verdicts: lang, name, kind, pass, divergence, message, and skipped and allowlisted where there are such;
    inputs: lang, role (corpus, oracle or manifest), path.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in verdicts.columns else F.lit(False)
    skipped, allowed = flag("skipped"), flag("allowlisted")
    failed = ~F.col("pass") & ~skipped
    entry = F.struct("name", "kind", "pass", "divergence", "message")
    count = lambda c: F.count(F.when(c, 1)).alias
    told = verdicts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("tests_executed"), count(F.col("pass"))("pass"), count(failed & F.col("divergence").isNotNull() & ~allowed)("divergences"),
        count(skipped)("skipped"), count(allowed)("allowlisted"), (F.count(F.when(failed & ~allowed, 1)) > 0).alias("fail_gate"), F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    none = F.array().cast("array<string>")
    own = (inputs if inputs is not None else verdicts.sparkSession.createDataFrame([], "lang string, role string, path string")).groupBy("lang").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("path")))).alias(name) for role, name in (("corpus", "corpora"), ("oracle", "oracles"), ("manifest", "manifests")))
    )
    both = told.join(own, "lang", "left").withColumns({n: F.coalesce(n, none) for n in ("corpora", "oracles", "manifests")})
    both = both.withColumns({"language": F.col("lang"), "clean": F.col("divergences") == 0, **{f"{n}_count": F.size(n) for n in ("corpora", "oracles", "manifests")}})
    return both.select("lang", F.to_json(F.struct(*REPORT, "entries", "manifests", "corpora", "oracles")).alias("report"))


def summary(told: DataFrame, smoke: bool = False) -> DataFrame:
    """One row, summary (JSON), over the reports of all languages."""
    of = F.from_json("report", "language string, divergences bigint, fail_gate boolean")
    one = F.struct(of["language"].alias("language"), of["divergences"].alias("divergences"), of["fail_gate"].alias("fail_gate"))
    made = told.select(one.alias("x")).agg(
        F.lit(smoke).alias("smoke"), F.count(F.lit(1)).alias("languages_checked"), F.coalesce(F.sum("x.divergences"), F.lit(0)).alias("total_divergences"),
        F.coalesce(F.max("x.fail_gate"), F.lit(False)).alias("had_unacceptable_failure"), F.sort_array(F.collect_list("x")).alias("per_language"),
    )
    return made.select(F.to_json(F.struct("*")).alias("summary"))


def write_report(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, or reports and summaries as they are."""
    if len(df.columns) <= 2 and df.columns[-1] in ("report", "summary"):
        df.select(df.columns[-1]).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)
