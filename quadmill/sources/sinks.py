"""Facts as text: N-Triples, N-Quads, Turtle and TriG."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T


def escaped_iri(t: Column) -> Column:
    """Characters that no IRI may hold as \\u escapes."""
    text = T.iri_text(t)
    made = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"\\u{ord(x):04X}")), [*map(chr, range(33)), "<", ">", '"', "{", "}", "|", "^", "`"], F.replace(text, F.lit("\\"), F.lit("\\u005C")))
    return F.when(text.rlike(r'[\x00-\x20<>"{}|^`\\]'), T.iri(made)).otherwise(t)


def quoted(text: Column) -> Column:
    """A literal's text between quotes on one line."""
    named = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    rest = [(chr(i), f"\\u{i:04X}") for i in range(32) if chr(i) not in "\n\r\t\b\f"] + [("\x7f", "\\u007F")]
    full = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), named + rest, text)
    made = F.when(text.rlike(r'[\x00-\x1f"\\\x7f]'), full).otherwise(text)
    return F.concat(F.lit('"'), made, F.lit('"'))


def line_term(t: Column) -> Column:
    return F.when(T.is_literal(t), F.concat(quoted(T.lexical(t)), T.suffix(t))).when(T.is_iri(t), escaped_iri(t)).otherwise(t)


def ntriples(facts: DataFrame) -> DataFrame:
    """A line for each fact; graphs are left out."""
    return facts.select(F.concat_ws(" ", *(line_term(F.col(c)) for c in ("s", "p", "o")), F.lit(".")).alias("value"))


def nquads(facts: DataFrame) -> DataFrame:
    return facts.select(F.concat_ws(" ", *(line_term(F.col(c)) for c in ("s", "p", "o", "g")), F.lit(".")).alias("value"))


def long_or_short(t: Column) -> Column:
    """Three quotes where the text holds a quote or a line end and ends in no quote."""
    text = T.lexical(t)
    body = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"""'), F.lit('""\\"'))
    long_ = F.concat(F.lit('"""'), body, F.lit('"""'))
    return F.when(F.contains(text, F.lit('"')) & ~F.endswith(text, F.lit('"')) & ~text.rlike(r"[\x00-\x08\x0b-\x1f\x7f]"), long_).otherwise(quoted(text))


def compact(t: Column, prefixes: dict[str, str]) -> Column:
    """A prefixed name by the longest namespace whose rest is plain, else the IRI."""
    text = T.iri_text(t)
    best = escaped_iri(t)
    for name, ns in sorted(prefixes.items(), key=lambda x: (len(x[1]), x[0])):
        local = F.substring(text, F.lit(len(ns) + 1), F.length(text))
        best = F.when(F.startswith(text, F.lit(ns)) & local.rlike(r"^(?:[A-Za-z_][A-Za-z0-9_\-]*)?$"), F.concat(F.lit(f"{name}:"), local)).otherwise(best)
    return best


def turtle_term(t: Column, prefixes: dict[str, str]) -> Column:
    tail = T.suffix(t)
    typed = F.startswith(tail, F.lit("^^"))
    literal = F.concat(long_or_short(t), F.when(typed, F.concat(F.lit("^^"), compact(F.substring(tail, F.lit(3), F.length(tail)), prefixes))).otherwise(tail))
    return F.when(T.is_literal(t), literal).when(T.is_iri(t), compact(t, prefixes)).otherwise(t)


def header(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {name}: <{ns}> .\n" for name, ns in sorted(prefixes.items()))


def statements(facts: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    return facts.withColumn("line", F.concat_ws(" ", *(turtle_term(F.col(c), prefixes) for c in ("s", "p", "o")), F.lit(".")))


def turtle(facts: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """doc_id, text: one document each, prefixes first, then a statement a line in order of the facts."""
    lines = statements(facts, prefixes)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "p", "o", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(F.concat(F.lit(header(prefixes) + ("\n" if prefixes else "")), text, F.lit("\n")).alias("text"))


def turtle_lines(facts: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """doc_id, line: documents of any size, a statement a line, in order over all partitions; what ``turtle`` gathers into texts."""
    rows = statements(facts, prefixes).select("doc_id", F.lit(1).alias("n"), "s", "p", "o", "line")
    none = F.lit(None).cast("string")
    heads = facts.select("doc_id").distinct().select("doc_id", F.lit(0).alias("n"), none.alias("s"), none.alias("p"), none.alias("o"), F.explode(F.array(*map(F.lit, [*header(prefixes).splitlines(), *([""] if prefixes else [])])) if prefixes else F.array().cast("array<string>")).alias("line"))
    return heads.unionByName(rows).orderBy("doc_id", "n", F.when(F.col("n") == 0, F.col("line") == "").otherwise(F.lit(False)), "s", "p", "o", "line").select("doc_id", "line")


def write_turtle(facts: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """A folder for each document, whose part files, one after the other, are its text."""
    turtle_lines(facts, prefixes).select("doc_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def trig(facts: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """doc_id, text: a block for each graph, the default one first and without a name."""
    lines = statements(facts, prefixes)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "p", "o", "line"))), lambda x: F.concat(F.lit("    "), x["line"])), "\n")
    blocks = lines.groupBy("doc_id", "g").agg(body.alias("body"))
    name = F.when(F.col("g").isNull(), F.lit("")).otherwise(F.concat(turtle_term(F.col("g"), prefixes), F.lit(" ")))
    block = F.concat(name, F.lit("{\n"), F.col("body"), F.lit("\n}\n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", block.alias("block")))), lambda x: x["block"]), "")
    return blocks.groupBy("doc_id").agg(F.concat(F.lit(header(prefixes) + ("\n" if prefixes else "")), text).alias("text"))


def trig_lines(facts: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """doc_id, line: documents of any size, blocks of graphs in order over all partitions; what ``trig`` gathers into texts."""
    none = F.lit(None).cast("string")
    place = lambda n, k, *terms: [F.lit(n).alias("n"), *(F.lit(None).cast("string").alias("g") if n == 0 else F.col("g"),), F.lit(k).alias("k"), *(t.alias(c) for t, c in zip(terms or [none] * 3, ("s", "p", "o"), strict=True))]
    rows = statements(facts, prefixes).select("doc_id", *place(1, 1, *map(F.col, ("s", "p", "o"))), F.concat(F.lit("    "), F.col("line")).alias("line"))
    graphs = facts.select("doc_id", "g").distinct()
    name = F.when(F.col("g").isNull(), F.lit("")).otherwise(F.concat(turtle_term(F.col("g"), prefixes), F.lit(" ")))
    opened, closed = graphs.select("doc_id", *place(1, 0), F.concat(name, F.lit("{")).alias("line")), graphs.select("doc_id", *place(1, 2), F.lit("}").alias("line"))
    top = [*header(prefixes).splitlines(), *([""] if prefixes else [])]
    heads = facts.select("doc_id").distinct().select("doc_id", *place(0, 0), F.posexplode(F.array(*map(F.lit, top)) if top else F.array().cast("array<string>")).alias("at", "line"))
    every = heads.unionByName(reduce(DataFrame.unionByName, (rows, opened, closed)).withColumn("at", F.lit(0)))
    return every.orderBy("doc_id", "n", "at", F.asc_nulls_first("g"), "k", "s", "p", "o", "line").select("doc_id", "line")


def write_trig(facts: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """A folder for each document, whose part files, one after the other, are its text."""
    trig_lines(facts, prefixes).select("doc_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def formatted(outcomes_facts: DataFrame, lang: str, prefixes: dict[str, str]) -> DataFrame:
    """Canonical facts back as text of their language."""
    if lang in ("nt", "nq"):
        made = (ntriples if lang == "nt" else nquads)(outcomes_facts.select("s", "p", "o", "g"))
        return made
    return (turtle if lang == "ttl" else trig)(outcomes_facts, prefixes)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
