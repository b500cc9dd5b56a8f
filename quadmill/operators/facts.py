"""Canonical facts, and their comparison.

Facts are rows of s, p, o and g (null: the default graph), with doc_id where several documents are held,
src_offset for the order of a source and parser for its name. What canonicalises works inside documents
and never orders or numbers over all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..session import written

QUAD = ["s", "p", "o", "g"]


def normalised(facts: DataFrame) -> DataFrame:
    return facts.withColumns({c: T.canonical(F.col(c)) for c in QUAD})


def relabelled(facts: DataFrame, order: str = "src_offset") -> DataFrame:
    """Blank nodes as _:c0, _:c1, ... in order of first appearance (s, o, then g) in a sort that is blind to labels.

    Ties keep the order of the source. A label's first place is a pre-aggregated minimum of the sort's key, so facts are
    neither sorted nor numbered; only a document's labels are.
    """
    blind = lambda c: F.when(T.is_bnode(F.col(c)), "_:").otherwise(F.col(c))
    key = [blind("s").alias("k1"), F.col("p").alias("k2"), blind("o").alias("k3"), blind("g").alias("k4"), F.col(order).alias("k5")]
    place = lambda c, i: F.when(T.is_bnode(F.col(c)), F.struct(F.col(c).alias("label"), F.struct(*key, F.lit(i).alias("k6")).alias("at")))
    places = facts.select("doc_id", F.explode(F.array_compact(F.array(*(place(c, i) for i, c in enumerate(("s", "o", "g")))))).alias("x")).select("doc_id", "x.label", "x.at")
    first = places.groupBy("doc_id", "label").agg(F.min("at").alias("at"))
    names = first.select(F.col("doc_id").alias("d_"), F.col("label").alias("l_"), F.concat(F.lit("_:c"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).cast("string")).alias("n_"))
    out = facts
    for c in ("s", "o", "g"):
        # Merged: names grow with the documents, and a broadcast of them would be held whole by every task. Other terms meet no label; they are dealt by their facts, so a common one fills no task.
        term = F.coalesce(F.when(T.is_bnode(F.col(c)), F.col(c)), F.concat(F.lit(" "), F.pmod(F.xxhash64(*QUAD), F.lit(997)).cast("string")))
        out = out.join(names.hint("merge"), (F.col("doc_id") == F.col("d_")) & (term == F.col("l_")), "left").withColumn(c, F.coalesce("n_", c)).drop("d_", "l_", "n_")
    return out


def deduplicated(facts: DataFrame, keys: list[str] | None = None, order: str = "src_offset") -> DataFrame:
    """One row for each quad, the earliest of its source."""
    keys = keys or (["doc_id"] if "doc_id" in facts.columns else []) + QUAD
    rest = [c for c in facts.columns if c not in keys]
    if not rest:
        return facts.select(*keys).distinct()
    best = facts.groupBy(*keys).agg(F.min(F.struct(*([order] if order in rest else []), *(c for c in rest if c != order))).alias("x"))
    return best.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest)).select(*facts.columns)


def canonicalise(facts: DataFrame) -> DataFrame:
    """Terms normalised, blank nodes relabelled within doc_id, duplicates gone."""
    return deduplicated(relabelled(normalised(facts)))


def canonicalise_rows(documents: DataFrame) -> DataFrame:
    """The same for documents that are a row each, in that row: documents has facts (structs with s, p, o, g and src_offset, of one parser), which become canonical."""
    node = lambda c: F.coalesce(T.is_bnode(c), F.lit(False))
    blind = lambda c: F.when(T.is_bnode(c), "_:").otherwise(c)
    fact = lambda f, how: F.struct(*(how(f[c]).alias(c) for c in QUAD), f["src_offset"].alias("src_offset"))

    def places(c: str, i: int) -> Column:
        return F.transform(F.filter("facts", lambda f: node(f[c])), lambda f: F.struct(blind(f["s"]).alias("k1"), f["p"].alias("k2"), blind(f["o"]).alias("k3"), blind(f["g"]).alias("k4"), f["src_offset"].alias("k5"), F.lit(i).alias("k6"), f[c].alias("label")))

    name = lambda c: F.when(node(c), F.concat(F.lit("_:c"), (F.array_position("names", c) - 1).cast("string"))).otherwise(c)
    alike = lambda f, i: F.coalesce(reduce(lambda a, b: a & b, [f[c].eqNullSafe(F.get("facts", i - 1)[c]) for c in QUAD]), F.lit(False))
    out = documents.withColumn("facts", F.transform("facts", lambda f: fact(f, T.canonical)))
    out = out.withColumn("names", F.array_distinct(F.transform(F.array_sort(F.concat(*(places(c, i) for i, c in enumerate(("s", "o", "g"))))), lambda x: x["label"])))
    out = out.withColumn("facts", F.array_sort(F.when(F.size("names") == 0, F.col("facts")).otherwise(F.transform("facts", lambda f: fact(f, name)))))
    # Sorted, equal quads are neighbours, the earliest first.
    return out.withColumn("facts", F.filter("facts", lambda f, i: (i == 0) | ~alike(f, i))).drop("names")


def violations(facts: DataFrame) -> DataFrame:
    """What breaks the rules of positions: the fact, the place and what is wrong there."""
    shape = lambda c: T.is_iri(c) & F.endswith(c, F.lit(">")) & (F.length(c) > 2) | T.is_bnode(c) & (F.length(c) > 2)
    literal = lambda c: T.is_literal(c) & (F.length(c) > 1) & c.rlike(r'(?s)"(?:@[A-Za-z0-9-]+|\^\^<[^>]+>)?$')
    good = {
        "s": shape(F.col("s")) | literal(F.col("s")), "p": T.is_iri(F.col("p")) & shape(F.col("p")), "o": shape(F.col("o")) | literal(F.col("o")), "g": F.col("g").isNull() | shape(F.col("g")),
    }
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in good.items())))
    return facts.withColumn("place", F.explode(found))


def check_canonical(facts: DataFrame) -> None:
    """Raises at the first fact that breaks a rule."""
    first = violations(facts).first()
    if first:
        raise ValueError(f"not canonical in {first.place}: {first.asDict()}")


def key_index(facts: DataFrame) -> DataFrame:
    """The set of objects of each (s, p, g)."""
    return facts.groupBy("s", "p", "g").agg(F.sort_array(F.collect_set("o")).alias("objects"))


def _same(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "g" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in columns])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts of a that b lacks; null graphs are equal."""
    return a.select(*QUAD).distinct().alias("a").join(b.select(*QUAD).alias("b"), _same(QUAD), "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*QUAD).union(b.select(*QUAD)).distinct()


def same_facts(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).isEmpty() and difference(b, a).isEmpty()


def diff(a: DataFrame, b: DataFrame, a_id: str = "a", b_id: str = "b") -> DataFrame:
    """kind, s, p, g, parser_id, o: objects on one side alone; FactOnlyIn where the other side lacks the key, else ObjectMismatch."""

    def side(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        only = difference(x, y)
        keys = y.select("s", "p", "g", F.lit(True).alias("there")).distinct()
        met = only.alias("a").join(keys.alias("b"), _same(["s", "p", "g"]), "left")
        return met.select(F.when(F.col("b.there"), "ObjectMismatch").otherwise("FactOnlyIn").alias("kind"), "a.s", "a.p", "a.g", F.lit(name).alias("parser_id"), "a.o")

    return side(a, b, a_id).union(side(b, a, b_id))


#: Sides whose marks share one long.
MARKS = 62


def fingerprints(facts: DataFrame) -> DataFrame:
    """s, p, g, n, h1, h2: for each key a fingerprint of its set of objects. Partial ones add up (counts by sum, hashes by xor), so no set is gathered."""
    own = facts.select(*QUAD).distinct()
    return own.groupBy("s", "p", "g").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("o")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "o")).alias("h2"))


def diff_many(sides: dict[str, DataFrame]) -> DataFrame:
    """kind, s, p, g, parser_id, o for each key on which the sides don't all hold the same objects.

    A strict majority is silent and the others speak; without one, all do. A side without the key speaks as
    FactOnlyIn with an empty object and its own name. No set is gathered in a row and no side compared with another: each
    fact gets a mark for each side that has it, the sides' sets of a key are compared by fingerprints of 128 bits and their
    sizes, and only the facts of sides that speak are read again.
    """
    names = sorted(sides)
    words = range(-(-len(names) // MARKS))
    mark = lambda i, w: F.lit(1 << i % MARKS if i // MARKS == w else 0).cast("long").alias(f"m{w}")
    tagged = reduce(DataFrame.union, [sides[n].select(*QUAD, *(mark(i, w) for w in words)) for i, n in enumerate(names)])
    masks = written(tagged.groupBy(*QUAD).agg(*(F.bit_or(f"m{w}").alias(f"m{w}") for w in words)))
    has = lambda i: F.getbit(F.col(f"m{i // MARKS}"), F.lit(i % MARKS)) == 1
    hashes = F.xxhash64("o"), F.xxhash64(F.lit(1), "o")

    def fingerprint(i: int) -> Column:
        return F.struct(F.count(F.when(has(i), 1)).alias("n"), *(F.coalesce(F.bit_xor(F.when(has(i), h)), F.lit(0)).alias(f"h{k}") for k, h in enumerate(hashes))).alias(f"x{i}")

    in_all = reduce(lambda a, b: a & b, map(has, range(len(names))))
    odd = masks.groupBy("s", "p", "g").agg(*map(fingerprint, range(len(names))), F.count(F.when(~in_all, 1)).alias("odd")).where("odd > 0")

    def same(i: int):
        return lambda y: y == F.col(f"x{i}")

    counted = odd.withColumn("sets", F.array(*(F.col(f"x{i}") for i in range(len(names))))).withColumn("alike", F.array(*(F.size(F.filter("sets", same(i))) for i in range(len(names)))))
    each = counted.select("s", "p", "g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("parser_id"), (F.col(f"x{i}.n") == 0).alias("lacks"), F.element_at("alike", i + 1).alias("n")) for i, n in enumerate(names)))).alias("x"))
    dissent = each.where(F.col("x.n") * 2 <= len(names)).select("s", "p", "g", "x.i", "x.parser_id", "x.lacks")
    silent = dissent.where("lacks").select(F.lit("FactOnlyIn").alias("kind"), "s", "p", "g", "parser_id", F.lit("").alias("o"))
    mask = F.element_at(F.array(*(F.col(f"b.m{w}") for w in words)), F.floor(F.col("a.i") / MARKS).cast("int") + 1)
    met = dissent.where("not lacks").alias("a").join(masks.alias("b"), _same(["s", "p", "g"])).where(F.getbit(mask, F.col("a.i") % MARKS) == 1)
    return silent.union(met.select(F.lit("ObjectMismatch").alias("kind"), "a.s", "a.p", "a.g", "a.parser_id", "b.o"))


def accept_split(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Documents that one parser takes and the other does not."""
    return a.select(key, F.col("accepted").alias("a")).join(b.select(key, F.col("accepted").alias("b")), key).where("a <> b").select(key, F.lit("AcceptRejectSplit").alias("kind"), F.col("a").alias("accepted_a"), F.col("b").alias("accepted_b"))


def allowed(verdicts: DataFrame, allow: DataFrame) -> DataFrame:
    """Verdicts that no entry of the allow-list (lang, name) suppresses."""
    return verdicts.join(allow.select("lang", "name").distinct(), ["lang", "name"], "left_anti")


def gate(verdicts: DataFrame) -> DataFrame:
    """Passed and failed by language, and whether the gate opens."""
    return verdicts.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("pass"), 1)).alias("passed"), F.count(F.when(~F.col("pass"), 1)).alias("failed")).withColumn("open", F.col("failed") == 0)
