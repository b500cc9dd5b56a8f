"""Canonical terms as columns: <iri>, _:label, "lexical" with ^^<datatype> or @tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: The datatypes derived from xsd:integer.
INTEGERS = [
    "integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger",
    "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
]


def is_iri(t: Column) -> Column:
    return F.startswith(t, F.lit("<"))


def is_bnode(t: Column) -> Column:
    return F.startswith(t, F.lit("_:"))


def is_literal(t: Column) -> Column:
    return F.startswith(t, F.lit('"'))


def iri_text(t: Column) -> Column:
    return F.substring(t, 2, F.length(t) - 2)


def iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def _closing(t: Column) -> Column:
    """Where the closing quote is: tags and datatypes hold no quotes, so it is the last one."""
    return F.length(t) - F.locate('"', F.reverse(t)) + 1


def raw_lexical(t: Column) -> Column:
    return F.substring(t, F.lit(2), _closing(t) - 2)


def suffix(t: Column) -> Column:
    return F.substring(t, _closing(t) + 1, F.length(t))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def lexical(t: Column) -> Column:
    return F.when(is_literal(t), unescape(raw_lexical(t)))


def language(t: Column) -> Column:
    """The tag, empty for other literals."""
    tail = suffix(t)
    return F.when(is_literal(t), F.when(F.startswith(tail, F.lit("@")), F.substring(tail, F.lit(2), F.length(tail))).otherwise(""))


def datatype(t: Column) -> Column:
    """The datatype's IRI as text."""
    tail = suffix(t)
    return F.when(is_literal(t), F.when(tail == "", XSD + "string").when(F.startswith(tail, F.lit("@")), RDF + "langString").otherwise(F.substring(tail, F.lit(4), F.length(tail) - 4)))


def string(text: Column) -> Column:
    return F.concat(F.lit('"'), escape(text), F.lit('"'))


def typed(text: Column, name: str) -> Column:
    """A literal of a type of XML Schema; the text needs no escapes."""
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{name}>'))


def fold_tag(tag: Column) -> Column:
    """The first part in lower case; four letters Title, two letters or three digits UPPER, the rest lower."""
    parts = F.split(tag, "-", -1)
    fold = lambda x, i: F.when(i == 0, F.lower(x)).when(x.rlike("^[A-Za-z]{4}$"), F.initcap(x)).when(x.rlike("^(?:[A-Za-z]{2}|[0-9]{3})$"), F.upper(x)).otherwise(F.lower(x))
    return F.array_join(F.transform(parts, fold), "-")


def wrap_iri(t: Column) -> Column:
    """Bare hierarchical IRIs get their brackets; whatever else there is stays."""
    return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://|/|#)"), iri(t)).otherwise(t)


def canonical(t: Column) -> Column:
    """One term in canonical form: brackets, folded tags, no explicit xsd:string."""
    tail = suffix(t)
    head = F.substring(t, F.lit(1), _closing(t))
    literal = F.when(tail == f"^^<{XSD}string>", head).when(F.startswith(tail, F.lit("@")), F.concat(head, F.lit("@"), fold_tag(F.substring(tail, F.lit(2), F.length(tail))))).otherwise(t)
    # What stands as it is, as most terms do, is told first.
    return F.when(is_iri(t) | is_bnode(t) | is_literal(t) & F.endswith(t, F.lit('"')) & (F.length(t) > 1), t).when(is_literal(t), literal).otherwise(wrap_iri(t))


def _of(t: Column, *names: str) -> Column:
    return suffix(t).isin([f"^^<{XSD}{x}>" for x in names])


def numeric_kind(t: Column) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double by the datatype alone."""
    return F.when(_of(t, *INTEGERS), 1).when(_of(t, "decimal"), 2).when(_of(t, "float"), 3).when(_of(t, "double"), 4)


def numeric_rank(t: Column) -> Column:
    """The kind of a valid number, null for anything else."""
    return F.when(to_double(t).isNotNull(), numeric_kind(t))


def to_double(t: Column) -> Column:
    text = raw_lexical(t)
    plain = F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double")).when(text == "INF", F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).when(text == "NaN", F.lit(float("nan")))
    return F.when(is_literal(t) & _of(t, *INTEGERS, "decimal", "float", "double"), plain)


def to_decimal(t: Column) -> Column:
    """Of integers and decimals alone."""
    text = raw_lexical(t)
    return F.when(is_literal(t) & _of(t, *INTEGERS, "decimal") & text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), text.try_cast("decimal(38,18)"))


def to_whole(t: Column) -> Column:
    """Of integers alone, exact to 38 digits."""
    text = raw_lexical(t)
    return F.when(is_literal(t) & _of(t, *INTEGERS) & text.rlike(r"^[+-]?\d+$"), text.try_cast("decimal(38,0)"))


def to_boolean(t: Column) -> Column:
    text = raw_lexical(t)
    return F.when(datatype(t) == XSD + "boolean", F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False))


def to_timestamp(t: Column) -> Column:
    """The moment of a dateTime or date; one without a zone is read as UTC."""
    text = raw_lexical(t)
    return F.when(datatype(t).isin(XSD + "dateTime", XSD + "date"), text.try_cast("timestamp"))


def decimal_text(x: Column) -> Column:
    text = x.cast("decimal(38,18)").cast("string")
    text = F.when(F.contains(text, F.lit("E")) | ~F.contains(text, F.lit(".")), F.format_string("%s", text)).otherwise(F.regexp_replace(text, r"\.?0+$", ""))
    return F.when(x == 0, F.lit("0")).otherwise(text)


def double_text(x: Column) -> Column:
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").otherwise(x.cast("string"))


def number(rank: Column, dec: Column, dbl: Column, big: Column) -> Column:
    """The literal of a number of that rank; null where the rank or the number is. big: the integer itself."""
    real = F.concat(F.lit('"'), double_text(dbl), F.when(rank == 3, f'"^^<{XSD}float>').otherwise(f'"^^<{XSD}double>'))
    return F.when(rank == 1, typed(big.cast("string"), "integer")).when(rank == 2, typed(decimal_text(dec), "decimal")).when(rank >= 3, real)


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _digits_key(text: Column) -> Column:
    """An order-preserving text for the number that a lexical form without INF or NaN says, whatever its length.

    A leading 1, 2 or 3 for the sign; then how many digits stand before the point, less zeros, in ten digits; then the digits without zeros at
    either end. Of negative numbers all digits are turned (9 less each) and a mark above all digits ends them, so longer ones come first.
    """
    zero, farthest = F.lit("0"), F.lit(4_000_000_000)
    mantissa = F.regexp_extract(text, r"^[+-]?([0-9.]*)", 1)
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("long"), F.lit(0))

    def parts(m: Column) -> Column:
        after = F.when(F.contains(m, F.lit(".")), F.substring_index(m, ".", -1)).otherwise("")
        return F.struct(F.ltrim(F.substring_index(m, ".", 1), zero).alias("before"), after.alias("after"))

    def sized(x: Column) -> Column:
        shorter = F.ltrim(x["after"], zero)
        size = F.when(x["before"] != "", F.length(x["before"])).otherwise(F.length(shorter) - F.length(x["after"])).cast("long")
        digits = F.rtrim(F.concat(x["before"], F.when(x["before"] != "", x["after"]).otherwise(shorter)), zero)
        return F.struct(size.alias("size"), digits.alias("digits"))

    def told(x: Column) -> Column:
        size = x["size"] + F.least(F.greatest(exponent, -farthest), farthest)
        key = F.concat(F.lpad((size + 5_000_000_000).cast("string"), 10, "0"), x["digits"])
        below = _let(key, lambda k: F.concat(F.lit("1"), F.translate(k, "0123456789", "9876543210"), F.lit("~")))
        return F.when(x["digits"] == "", "2").when(F.startswith(text, F.lit("-")), below).otherwise(F.concat(F.lit("3"), key))

    return _let(_let(_let(mantissa, parts), sized), told)


def number_key(t: Column) -> Column:
    """A text that sorts as the value of a numeric literal, null for other terms: -INF, numbers of any length exactly, INF, NaN.

    Integers and decimals count as they are written, doubles as the shortest number that reads as the same double.
    """

    def told(x: Column) -> Column:
        real = x["real"]
        special = F.when(F.isnan(real), "5").when(~x["exact"] & (real == float("inf")), "4").when(~x["exact"] & (real == float("-inf")), "0")
        return F.when(real.isNotNull(), F.coalesce(special, _let(F.when(x["exact"], x["text"]).otherwise(real.cast("string")), _digits_key)))

    return _let(F.struct(raw_lexical(t).alias("text"), to_double(t).alias("real"), _of(t, *INTEGERS, "decimal").alias("exact")), told)


def order_key(t: Column) -> Column:
    """Unbound, blank nodes, IRIs, literals; numbers by value, the rest by moment or text."""
    return F.struct(
        F.when(t.isNull(), 0).when(is_bnode(t), 1).when(is_iri(t), 2).otherwise(3).alias("kind"),
        number_key(t).alias("number"),
        F.unix_micros(to_timestamp(t)).alias("moment"),
        F.when(is_literal(t), lexical(t)).otherwise(t).alias("text"),
        t.alias("term"),
    )
