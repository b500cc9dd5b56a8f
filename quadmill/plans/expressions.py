"""SPARQL expressions as Spark columns.

A value is kept in the form that made it: a term, a truth value or a number (rank, decimal, double); the
other forms are derived when asked for, so arithmetic and comparisons don't pass through strings. An error
is NULL, and NULL is an error: three-valued logic is what SPARQL's tables ask for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import iri as I
from ..functions import terms as T
from .sparql_parser import XSD, SparqlError

class Number(NamedTuple):
    """rank (1 integer, 2 decimal, 3 float, 4 double), and the value: as a decimal, as a double, and of integers whole."""

    rank: Column
    dec: Column
    dbl: Column
    big: Column


def no_decimal() -> Column:
    return F.lit(None).cast("decimal(38,18)")


def no_whole() -> Column:
    return F.lit(None).cast("decimal(38,0)")


@dataclass(frozen=True)
class Native:
    """What a column of a table holds that a variable's terms are made of: key (with the text before it), integer, double or string."""

    kind: str
    before: str = ""

    def value(self, term: Column, own: Column) -> Value:
        if self.kind == "key":
            return Value(term, kind="other", key=(self.before, own.cast("long")))
        if self.kind == "string":
            return Value(term, kind="string", lex=own)
        if self.kind == "integer":
            n = own.cast("long")
            return Value(term, number=Number(F.when(n.isNotNull(), 1), n.cast("decimal(38,18)"), n.cast("double"), n.cast("decimal(38,0)")), long=n)
        n = own.cast("double")
        return Value(term, number=Number(F.when(n.isNotNull(), 4), no_decimal(), n, no_whole()), real=True)


class Value:
    def __init__(self, term: Column | None = None, truth: Column | None = None, number: Number | None = None, kind: str | None = None, lex: Column | None = None, long: Column | None = None, real: bool = False, key: tuple[str, Column] | None = None):
        self._term, self._truth, self._number = term, truth, number
        #: What it is in every row, where that is known: number, truth, string, moment or other.
        self.kind = kind or ("number" if number else "truth" if truth is not None else None)
        #: The text of what is always a simple literal; the number of what is always a small integer; always a float or double;
        #: the text before a key and the key.
        self.lex, self.long, self.real, self.key = lex, long, real, key

    @property
    def term(self) -> Column:
        if self._term is None:
            self._term = T.number(*self._number) if self._number else T.typed(F.when(self._truth, "true").when(~self._truth, "false"), "boolean")
        return self._term

    @property
    def number(self) -> Number:
        if self._number is None:
            if self._term is None:
                self._number = Number(F.lit(None).cast("int"), no_decimal(), F.lit(None).cast("double"), no_whole())
            else:
                self._number = Number(T.numeric_kind(self._term), T.to_decimal(self._term), T.to_double(self._term), T.to_whole(self._term))
        return self._number

    @property
    def truth(self) -> Column:
        """The effective boolean value."""
        if self._truth is None:
            real = self.number.dbl
            as_number = F.when(real.isNotNull(), (real != 0) & ~F.isnan(real))
            if self.kind == "number":
                self._truth = as_number
            else:
                t = self._term
                string = F.when(T.suffix(t) == "", T.raw_lexical(t) != "").when(F.startswith(T.suffix(t), F.lit("@")), T.raw_lexical(t) != "")
                truth = F.when(T.suffix(t) == f"^^<{XSD}boolean>", F.coalesce(T.to_boolean(t), F.lit(False)))
                self._truth = F.when(T.is_literal(t), F.coalesce(truth, string, as_number))
        return self._truth


def text(v: Value) -> Column:
    """The lexical form of a literal, null for others."""
    return T.lexical(v.term) if v.lex is None else v.lex


def plain(v: Value) -> Column:
    """The text of simple and tagged literals alone."""
    return F.when(T.datatype(v.term).isin(XSD + "string", T.RDF + "langString"), T.lexical(v.term)) if v.lex is None else v.lex


def like(v: Value, result: Column) -> Value:
    """A string with the tag of its argument."""
    if v.lex is not None:
        return Value(T.string(result), kind="string", lex=result)
    tag = T.language(v.term)
    return Value(F.concat(T.string(result), F.when(tag != "", F.concat(F.lit("@"), tag)).otherwise("")))


def compatible(a: Value, b: Value) -> Column:
    """Arguments that string functions take together: the second is simple, or both have one tag."""
    return F.lit(True) if b.lex is not None else (T.language(b.term) == "") | (T.language(a.term) == T.language(b.term))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Decimals where both sides have one, else doubles; what can't be computed is null in both."""
    (ra, da, fa, ba), (rb, db, fb, bb) = a.number, b.number
    # An error on one side is one of the whole: greatest would skip it.
    rank = F.when(ra.isNotNull() & rb.isNotNull(), F.greatest(ra, rb) if op != "/" else F.greatest(ra, rb, F.lit(2)))
    way = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    # Whole numbers are divided as decimals; those too large for one are taken whole.
    as_decimal = F.coalesce(way(da, db).try_cast("decimal(38,18)"), way(ba, bb).try_cast("decimal(38,18)")) if op == "/" else way(da, db).try_cast("decimal(38,18)")
    as_double = fa + fb if op == "+" else fa - fb if op == "-" else fa * fb if op == "*" else F.when(fb != 0, fa / fb).when(fa == 0, F.lit(float("nan"))).otherwise(fa * F.lit(float("inf")))
    return Value(number=Number(rank, as_decimal, as_double, no_whole() if op == "/" else way(ba, bb).try_cast("decimal(38,0)")), real=a.real or b.real)


#: An IRI that ends in a number written the usual way.
KEYED = re.compile(r"(<.*?)(0|-?[1-9]\d{0,17})>")


def constant(term: str) -> Value:
    """The value of a term in the query, worked out once."""
    if term.startswith('"'):
        cut = term.rindex('"')
        lex, tail = term[1:cut], term[cut + 1 :]
        name = tail[len(XSD) + 3 : -1] if tail.startswith(f"^^<{XSD}") else None
        try:
            if name in T.INTEGERS or name == "decimal":
                real, is_whole = float(lex), name != "decimal"
                own = Number(F.lit(1 if is_whole else 2), F.lit(lex).try_cast("decimal(38,18)"), F.lit(real), F.lit(lex).try_cast("decimal(38,0)") if is_whole else no_whole())
                return Value(F.lit(term), number=own, long=F.lit(int(lex)).cast("long") if is_whole and abs(int(lex)) < 1 << 63 else None)
            if name in ("double", "float"):
                return Value(F.lit(term), number=Number(F.lit(4 if name == "double" else 3), no_decimal(), F.lit(float(lex)), no_whole()), real=True)
        except ValueError:
            return Value(F.lit(term))
        if name == "boolean":
            return Value(F.lit(term), truth=F.lit(lex in ("true", "1")))
        if not tail:
            return Value(F.lit(term), kind="string", lex=F.lit(re.sub(r"(?s)\\(.)", r"\1", lex)))
        return Value(F.lit(term), kind="moment" if name in ("dateTime", "date") else None)
    keyed = KEYED.fullmatch(term)
    return Value(F.lit(term), kind="other", key=(keyed[1], F.lit(int(keyed[2])).cast("long")) if keyed else None)


def numbers(a: Value, b: Value, f: Callable[[Column, Column], Column]) -> Column:
    """By the plainest form that both have, so a comparison with a table's column can reach its scan."""
    if a.long is not None and b.long is not None:
        return f(a.long, b.long)
    if a.real or b.real:
        return f(a.number.dbl, b.number.dbl)
    return F.coalesce(f(a.number.dec, b.number.dec), f(a.number.big, b.number.big), f(a.number.dbl, b.number.dbl))


def order_key(v: Value) -> Column:
    """What solutions are ordered by; where all values of a column are made of one kind, by what they are made of."""
    t = v.term
    own = v.long if v.long is not None else v.number.dbl if v.real else v.lex
    return T.order_key(t) if own is None else F.struct(F.when(t.isNull(), 0).otherwise(3).alias("kind"), own.alias("own"), t.alias("term"))


def strings(a: Value, b: Value, f: Callable[[Column, Column], Column]) -> Column:
    simple = lambda v: v.lex if v.lex is not None else F.when(T.is_literal(v.term) & (T.suffix(v.term) == ""), T.lexical(v.term))
    return f(simple(a), simple(b))


def moments(a: Value, b: Value, f: Callable[[Column, Column], Column]) -> Column:
    return F.when(T.suffix(a.term) == T.suffix(b.term), f(T.to_timestamp(a.term), T.to_timestamp(b.term)))


def truths(a: Value, b: Value, f: Callable[[Column, Column], Column]) -> Column:
    own = lambda v: v.truth if v.kind == "truth" else T.to_boolean(v.term)
    return f(own(a), own(b))


def ordered(a: Value, b: Value, f: Callable[[Column, Column], Column]) -> Column:
    """A comparison of what can be ordered: numbers, strings, truth values, moments. A kind known of one side is the only one tried."""
    kinds = {"number": numbers, "string": strings, "truth": truths, "moment": moments}
    known = {v.kind for v in (a, b)} - {None}
    if known:
        return kinds[known.pop()](a, b, f) if len(known) == 1 and "other" not in known else F.lit(None).cast("boolean")
    return F.coalesce(*(way(a, b, f) for way in kinds.values()))


def equal(a: Value, b: Value) -> Column:
    """Equality by value; two different literals of types unknown here are an error."""
    same = lambda x, y: x == y
    if a.kind == b.kind == "number":
        return numbers(a, b, same)
    if a.lex is not None and b.lex is not None:
        return a.lex == b.lex
    if a.key and b.key and a.key[0] == b.key[0]:
        return a.key[1] == b.key[1]
    if "other" in (a.kind, b.kind):
        return a.term == b.term
    by_value = ordered(a, b, same)
    # Literals of different known kinds, and anything beside a literal, differ; so do tagged strings.
    kind = lambda v: F.lit(v.kind) if v.kind else F.when(~T.is_literal(v.term), "term").when(T.suffix(v.term) == "", "string").when(T.language(v.term) != "", "tagged").when(v.number.dbl.isNotNull(), "number").when(T.to_boolean(v.term).isNotNull(), "truth").when(T.to_timestamp(v.term).isNotNull(), "moment")
    ka, kb = kind(a), kind(b)
    return F.coalesce(by_value, F.when(a.term == b.term, True).when((ka != kb) | ((ka == kb) & ka.isin("term", "tagged")), False).when(T.is_literal(a.term) != T.is_literal(b.term), False))


def moment(v: Value, pattern: str) -> Column:
    found = F.regexp_extract(T.raw_lexical(v.term), pattern, 1)
    return F.when(T.datatype(v.term).isin(XSD + "dateTime", XSD + "date", XSD + "time") & (found != ""), found)


def whole(c: Column) -> Value:
    d = c.cast("decimal(38,18)")
    return Value(number=Number(F.when(c.isNotNull(), 1), d, c.cast("double"), c.cast("decimal(38,0)")))


def rounded(v: Value, name: str) -> Value:
    rank, dec, dbl, big = v.number
    if name == "ABS":
        return Value(number=Number(rank, F.abs(dec), F.abs(dbl), F.abs(big)))
    up = {"CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda x: F.floor(x + F.lit(0.5).cast(x_type(x)))}[name]
    d = up(dec).cast("decimal(38,18)") if name != "ROUND" else F.floor(dec + F.expr("cast(0.5 as decimal(2,1))")).cast("decimal(38,18)")
    f = F.when((F.abs(dbl) > 9e15) | F.isnan(dbl), dbl).otherwise({"CEIL": F.ceil(dbl), "FLOOR": F.floor(dbl), "ROUND": F.floor(dbl + 0.5)}[name].cast("double"))
    return Value(number=Number(rank, d, f, big))


def x_type(_: Column) -> str:
    return "double"


def java_pattern(pattern: Column, flags: Column | None) -> Column:
    if flags is None:
        return pattern
    literal = F.when(F.contains(flags, F.lit("q")), F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))).otherwise(pattern)
    on = F.regexp_replace(flags, "[^ismx]", "")
    return F.when(on != "", F.concat(F.lit("(?"), on, F.lit(")"), literal)).otherwise(literal)


@F.pandas_udf(BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    def one(pattern: str | None) -> bool:
        try:
            return pattern is not None and regex.compile(pattern) is not None
        except regex.error:
            return False

    return patterns.map({p: one(p) for p in patterns.unique()}).astype(bool)


def checked(pattern: Column, parts: list) -> tuple[Column, Column]:
    """Whether a pattern (made of the expressions parts) can be used, and how many groups it has: told at once where it is fixed."""
    if all(p[0] == "lit" for p in parts):
        fixed, *flags = (re.sub(r"(?s)\\(.)", r"\1", p[1][1 : p[1].rindex('"')]) for p in parts)
        fixed = f"\\Q{fixed}\\E" if flags and "q" in flags[0] else fixed
        on = re.sub("[^ismx]", "", flags[0]) if flags else ""
        try:
            made = SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"(?{on}){fixed}" if on else fixed)
            return F.lit(True), F.lit(made.matcher("").groupCount())
        except IllegalArgumentException:
            return F.lit(False), F.lit(0)
    return _compiles(pattern), F.char_length(F.regexp_replace(pattern, r"\\.|\[(?:[^\]\\]|\\.)*\]|\(\?|[^(]", ""))


HASHES = {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256), "SHA384": lambda c: F.sha2(c, 384), "SHA512": lambda c: F.sha2(c, 512)}
ZONE = r"(Z|[+-]\d\d:\d\d)$"
FUNCTIONS: dict[str, Callable[[list[Value]], Value]] = {}


class Compiler:
    """Compiles expressions; column: what holds a variable, or None where it is unbound."""

    def __init__(self, column: Callable[[str], Column | None], base: str | None = None, row: Column | None = None, functions: dict | None = None):
        self.column, self.base, self.row, self.functions = column, base, row, functions or FUNCTIONS

    def __call__(self, e) -> Value:
        kind = e[0]
        if kind == "var":
            c = self.column(e[1])
            return c if isinstance(c, Value) else Value(F.lit(None).cast("string") if c is None else c)
        if kind in ("lit", "iri"):
            return constant(e[1])
        if kind == "column":
            return e[1]
        if kind == "or":
            return Value(truth=self(e[1]).truth | self(e[2]).truth)
        if kind == "and":
            return Value(truth=self(e[1]).truth & self(e[2]).truth)
        if kind == "not":
            return Value(truth=~self(e[1]).truth)
        if kind == "sign":
            v = self(e[2])
            if e[1] == "+":
                return Value(number=v.number, long=v.long, real=v.real)
            rank, dec, dbl, big = v.number
            return Value(number=Number(rank, -dec, -dbl, -big), long=None if v.long is None else -v.long, real=v.real)
        if kind == "math":
            return arithmetic(e[1], self(e[2]), self(e[3]))
        if kind == "cmp":
            a, b = self(e[2]), self(e[3])
            if e[1] in ("=", "!="):
                same = equal(a, b)
                return Value(truth=same if e[1] == "=" else ~same)
            return Value(truth=ordered(a, b, {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[e[1]]))
        if kind == "in":
            a = self(e[1])
            some = reduce(lambda x, y: x | y, [equal(a, self(b)) for b in e[2]], F.lit(False))
            return Value(truth=~some if e[3] else some)
        if kind == "call":
            return self.cast(e[1], [self(x) for x in e[2]])
        if kind == "fn":
            return self.function(e[1], e[2])
        raise SparqlError("SPARQL-SYNTAX-001", f"{kind} can't stand here", 0)

    def cast(self, name: str, args: list[Value]) -> Value:
        if name in self.functions:
            return self.functions[name](args)
        if not name.startswith(XSD) or len(args) != 1:
            return Value(F.lit(None).cast("string"))
        v, to = args[0], name[len(XSD) :]
        t = v.term
        source = F.when(T.is_iri(t), T.iri_text(t)).otherwise(T.lexical(t)) if to == "string" else F.trim(T.lexical(t))
        if to == "string":
            return Value(T.string(source))
        rank, dec, dbl, big = v.number
        truth = T.to_boolean(t)
        if to == "boolean":
            return Value(truth=F.when(dbl.isNotNull(), (dbl != 0) & ~F.isnan(dbl)).when(source.isin("true", "1"), True).when(source.isin("false", "0"), False))
        if to in ("integer", "decimal"):
            made = F.coalesce(dec, F.when(~F.isnan(dbl) & (F.abs(dbl) != float("inf")), dbl.try_cast("decimal(38,18)")), truth.cast("int").cast("decimal(38,18)"))
            stringy = T.datatype(t).isin(XSD + "string")
            shape = r"^[+-]?\d+$" if to == "integer" else r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"
            made = F.when(stringy & source.rlike(shape), source.try_cast("decimal(38,18)")).otherwise(made)
            if to == "integer":
                made = F.when(made < 0, F.ceil(made)).otherwise(F.floor(made)).cast("decimal(38,18)")
            if to == "decimal":
                return Value(number=Number(F.when(made.isNotNull(), 2), made, made.cast("double"), no_whole()))
            exact = F.coalesce(big, F.when(stringy & source.rlike(shape), source.try_cast("decimal(38,0)")), made.cast("decimal(38,0)"))
            return Value(number=Number(F.when(exact.isNotNull(), 1), made, exact.cast("double"), exact))
        if to in ("double", "float"):
            real = source.rlike(r"^(?:[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|-?INF|NaN)$")
            made = F.when(dbl.isNotNull(), dbl).when(truth.isNotNull(), truth.cast("int").cast("double")).when((T.datatype(t) == XSD + "string") & real, T.to_double(T.typed(source, "double")))
            return Value(number=Number(F.when(made.isNotNull(), 4 if to == "double" else 3), no_decimal(), made, no_whole()), real=True)
        if to in ("dateTime", "date"):
            good = source.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?$") if to == "dateTime" else source.rlike(r"^-?\d{4,}-\d\d-\d\d(?:Z|[+-]\d\d:\d\d)?$")
            return Value(F.when(T.datatype(t).isin(XSD + "string", name) & good & source.try_cast("timestamp").isNotNull(), T.typed(source, to)))
        return Value(F.when(T.is_literal(t), T.typed(T.escape(source), to)))

    def function(self, name: str, args: list) -> Value:
        if name == "BOUND":
            c = self.column(args[0][1])
            return Value(truth=F.lit(False) if c is None else (c.term if isinstance(c, Value) else c).isNotNull())
        v = [self(a) for a in args]
        none = F.lit(None).cast("string")
        if name == "COALESCE":
            return Value(F.coalesce(*(x.term for x in v)))
        if name == "IF":
            return Value(F.when(v[0].truth, v[1].term).when(~v[0].truth, v[2].term))
        if name == "CONCAT":
            if not v:
                return Value(F.lit('""'))
            tags = [T.language(x.term) for x in v]
            joined = T.string(F.concat(*(plain(x) for x in v)))
            same = reduce(lambda a, b: a & b, [t == tags[0] for t in tags], F.lit(True))
            return Value(F.concat(joined, F.when(same & (tags[0] != ""), F.concat(F.lit("@"), tags[0])).otherwise("")))
        if name in ("RAND", "NOW", "UUID", "STRUUID"):
            if name == "RAND":
                return Value(number=Number(F.lit(4), no_decimal(), F.rand(), no_whole()), real=True)
            if name == "NOW":
                return Value(T.typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "dateTime"))
            return Value(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")) if name == "UUID" else T.string(F.uuid()))
        if name == "BNODE":
            if not v:
                return Value(F.concat(F.lit("_:b"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
            if self.row is None:
                raise SparqlError("SPARQL-BNODE-001", "BNODE of a text can't stand here", 0)
            return Value(F.concat(F.lit("_:b"), F.md5(F.concat(self.row, F.lit(" "), plain(v[0])).cast("binary"))))
        a = v[0]
        t = a.term
        if name == "STR":
            return Value(T.string(F.when(T.is_iri(t), T.iri_text(t)).otherwise(T.lexical(t))))
        if name == "LANG":
            return Value(T.string(T.language(t)))
        if name == "DATATYPE":
            return Value(T.iri(T.datatype(t)))
        if name == "LANGMATCHES":
            tag, want = F.lower(text(a)), F.lower(text(v[1]))
            return Value(truth=F.when(want == "*", tag != "").otherwise((tag == want) | F.startswith(tag, F.concat(want, F.lit("-")))))
        if name in ("IRI", "URI"):
            raw = F.when(T.is_iri(t), T.iri_text(t)).otherwise(plain(a))
            return Value(T.iri(I.resolve(F.lit(self.base), raw) if self.base else raw))
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            return rounded(a, name)
        if name == "STRLEN":
            return whole(F.char_length(plain(a)))
        if name == "SUBSTR":
            start = v[1].number.dbl
            first = F.floor(start + 0.5)
            end = F.char_length(plain(a)) + 1 if len(v) < 3 else first + F.floor(v[2].number.dbl + 0.5)
            low = F.greatest(first, F.lit(1))
            return like(a, F.substring(plain(a), low.cast("int"), F.greatest(end - low, F.lit(0)).cast("int")))
        if name in ("UCASE", "LCASE"):
            return like(a, (F.upper if name == "UCASE" else F.lower)(plain(a)))
        if name == "ENCODE_FOR_URI":
            coded = F.url_encode(plain(a))
            return Value(T.string(F.replace(F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))))
        if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
            f = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name]
            return Value(truth=F.when(compatible(a, v[1]), f(plain(a), plain(v[1]))))
        if name in ("STRBEFORE", "STRAFTER"):
            own, mark = plain(a), plain(v[1])
            at = F.position(mark, own)
            cut = F.substring(own, F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(own, at + F.char_length(mark), F.char_length(own))
            return Value(F.when(compatible(a, v[1]), F.when(at > 0, like(a, cut).term).otherwise(F.lit('""'))))
        if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES"):
            pattern = {"YEAR": r"^(-?\d{4,})-", "MONTH": r"^-?\d{4,}-(\d\d)-", "DAY": r"^-?\d{4,}-\d\d-(\d\d)", "HOURS": r"T(\d\d):", "MINUTES": r"T\d\d:(\d\d):"}[name]
            return whole(moment(a, pattern).cast("int"))
        if name == "SECONDS":
            d = moment(a, r"T\d\d:\d\d:(\d\d(?:\.\d+)?)").cast("decimal(38,18)")
            return Value(number=Number(F.when(d.isNotNull(), 2), d, d.cast("double"), no_whole()))
        if name == "TZ":
            return Value(F.when(T.datatype(t) == XSD + "dateTime", T.string(F.regexp_extract(T.raw_lexical(t), ZONE, 1))))
        if name == "TIMEZONE":
            zone = moment(a, ZONE)
            hours, minutes = F.substring(zone, 2, 2).cast("int"), F.substring(zone, 5, 2).cast("int")
            made = F.concat(F.when(F.startswith(zone, F.lit("-")) & (hours + minutes > 0), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
            return Value(T.typed(F.when((zone == "Z") | (hours + minutes == 0), "PT0S").otherwise(made), "dayTimeDuration"))
        if name in HASHES:
            return Value(T.string(HASHES[name](plain(a).cast("binary"))))
        if name == "STRLANG":
            return Value(F.when(T.datatype(t) == XSD + "string", F.concat(t, F.lit("@"), T.fold_tag(text(v[1])))))
        if name == "STRDT":
            kind = T.iri_text(v[1].term)
            return Value(F.when(T.datatype(t) == XSD + "string", F.when(kind == XSD + "string", t).otherwise(F.concat(t, F.lit("^^"), v[1].term))))
        if name == "SAMETERM":
            return Value(truth=t == v[1].term)
        if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            return Value(truth={"ISBLANK": T.is_bnode, "ISLITERAL": T.is_literal}.get(name, T.is_iri)(t))
        if name == "ISNUMERIC":
            return Value(truth=F.when(t.isNotNull(), a.number.dbl.isNotNull()))
        if name == "REGEX":
            pattern = java_pattern(text(v[1]), text(v[2]) if len(v) > 2 else None)
            return Value(truth=F.when(checked(pattern, args[1:])[0], F.regexp(plain(a), pattern)))
        if name == "REPLACE":
            pattern, by = java_pattern(text(v[1]), text(v[3]) if len(v) > 3 else None), text(v[2])
            good, groups = checked(pattern, args[1:2] + args[3:])
            # A bare $ or \ in the replacement, a group that isn't there and a pattern that matches nothing at all are errors.
            named = F.regexp_extract_all(F.regexp_replace(by, r"\\.", ""), F.lit(r"\$(\d)"), F.lit(1))
            good &= by.rlike(r"^(?:[^\\$]|\\[\\$]|\$\d)*$") & ~F.exists(named, lambda d: d.cast("int") > groups)
            return like(a, F.when(good, F.when(~F.regexp(F.lit(""), pattern), F.regexp_replace(plain(a), pattern, by))))
        return Value(none)
