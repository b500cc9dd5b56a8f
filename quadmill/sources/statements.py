"""Turtle documents by statements, so that after an edit only those statements are parsed that differ.

A document is cut at full stops that end a statement. What a statement means depends on its text, the base and the prefixes that it names: a hash
of these is its key, whatever document it stands in and wherever. Facts of keys that are known are taken as they are and moved to their new
place; the statements of other keys are parsed, each key once. Blank nodes without a label get one by their statement's number. Documents in which
a statement is none by itself are parsed whole, as ``reader.parse`` does, for what they say and the errors they have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.iri import resolve_text
from ..operators import facts as O
from ..session import written
from .rdf_text import parse_text
from .reader import FACT, ROW, facts_of, parse

#: What a full stop doesn't end a statement within, and the stops that do: before what can't go on a name or a number.
PIECE = re.compile(
    r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""|\'\'\'(?:\'{0,2}(?:[^\'\\]|\\.))*\'\'\'|"(?:[^"\\\r\n]|\\.)*"|\'(?:[^\'\\\r\n]|\\.)*\'|<[^<>"{}|^`\\\x00-\x20]*>|\#[^\r\n]*|(?P<stop>\.(?![\w%\\:\-.·]))', re.S
)
DIRECTIVE = re.compile(r"(?:\s|\#[^\r\n]*(?:[\r\n]|\Z))*(?:@prefix\s+(?P<p>[^\s:]*):\s*<(?P<n>[^<>]*)>\s*\.|@base\s*<(?P<b>[^<>]*)>\s*\.|(?i:prefix)\s+(?P<q>[^\s:]*):\s*<(?P<m>[^<>]*)>|(?i:base)\s*<(?P<c>[^<>]*)>)")
USED = re.compile(r"([^\s<>\"'(){}\[\];,.^:@](?:[^\s<>\"'(){}\[\];,^:@]*[^\s<>\"'(){}\[\];,.^:@])?)?:")
BETWEEN = re.compile(r"(?:\s|\#[^\r\n]*(?:[\r\n]|\Z))*")

Statement = tuple[int, str, str]  # where it begins, the directives that it needs, its text


def split_statements(text: str, base: str | None = None) -> list[Statement]:
    """The statements and directives of a document in order; those directives that a statement uses go with it."""
    prefixes: dict[str, str] = {}
    out: list[Statement] = []
    at = int(text.startswith("﻿"))
    while (at := BETWEEN.match(text, at).end()) < len(text):  # type: ignore[union-attr]
        head = f"@base <{base}> .\n" if base else ""
        if m := DIRECTIVE.match(text, at):
            name = m["p"] if m["n"] is not None else m["q"]
            iri = next(x for x in (m["n"], m["b"], m["m"], m["c"]) if x is not None)
            out.append((at, head, m[0]))
            whole = resolve_text(base, iri) if base else iri
            if name is None:
                base = whole
            else:
                prefixes[name] = whole
            at = m.end()
            continue
        stop = next((m.end() for m in PIECE.finditer(text, at) if m["stop"]), len(text))
        own = text[at:stop]
        names = sorted({x or "" for x in USED.findall(own)} & prefixes.keys())
        head += "".join(f"@prefix {n}: <{prefixes[n]}> .\n" for n in names)
        out.append((at, head, own.strip()))
        at = stop
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = split_statements((content or b"").decode("utf-8", "surrogateescape"), base)
            texts = [(head + text).encode("utf-8", "surrogateescape") for _, head, text in own]
            columns = [([path] * len(own), pa.string()), (range(len(own)), pa.int64()), ([a for a, _, _ in own], pa.int64()), ([sha256(t).digest() for t in texts], pa.binary()), (texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=["path", "n", "at", "key", "text"])


def statements(docs: DataFrame) -> DataFrame:
    """path, n (from 0), at (where it begins, in characters), key, text (with the directives that it needs) of Turtle documents (path, content, base)."""
    base = F.col("base") if "base" in docs.columns else F.lit(None).cast("string")
    return docs.select("path", base.alias("base"), F.col("content").cast("binary").alias("content")).mapInArrow(_cut, "path string, n long, at long, key binary, text binary")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, facts, good = batch.column(0).to_pylist(), [], []
        for text in batch.column(1).to_pylist():
            try:
                quads = parse_text(text.decode("utf-8"), "ttl", None)[0]
                facts.append([{**dict(zip(("s", "p", "o", "g"), q, strict=True)), "src_offset": i} for i, q in enumerate(quads)])
                good.append(True)
            except ValueError:
                facts.append([])
                good.append(False)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(good, pa.bool_()), pa.array(facts, pa.list_(ROW))], names=["key", "good", "facts"])


def reparsed(docs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The facts of Turtle documents, the table of known statements (key, good, facts) with theirs, and the statements that had to be parsed (key, text).

    Facts are canonical, as those of ``reader.facts_of``. known: that table from an earlier time, which may hold any statements of any documents.
    """
    own = written(statements(docs))
    kinds = own.select("key", "text").dropDuplicates(["key"])
    new = written(kinds if known is None else kinds.join(known.select("key"), "key", "left_anti"))
    made = written(new.mapInArrow(_parsed, f"key binary, good boolean, facts array<{FACT}>"))
    every = made if known is None else known.unionByName(made)
    met = own.select("path", "n", "key").join(every, "key")
    odd = met.where("not good").select("path").distinct()
    # Labels that no document can write are told apart by their statement; a fact's place is its statement's, then its own.
    term = lambda c: F.when(F.startswith(F.col(c), F.lit("_:.")), F.concat(F.lit("_:.s"), F.col("n").cast("string"), F.substring(c, 3, 1 << 30))).otherwise(F.col(c)).alias(c)
    told = met.join(odd, "path", "left_anti").select("path", "n", F.explode("facts").alias("f")).select(F.col("path").alias("doc_id"), "n", "f.s", "f.p", "f.o", "f.g", (F.col("n") * (1 << 24) + F.col("f.src_offset")).alias("src_offset"))
    facts = told.select("doc_id", *(term(c) for c in ("s", "p", "o", "g")), "src_offset", F.lit("ttl").alias("parser"))
    whole = facts_of(parse(docs.join(odd, "path", "left_semi").withColumn("lang", F.lit("ttl"))), canonical=False)
    return O.canonicalise(facts.unionByName(whole)), every, new
