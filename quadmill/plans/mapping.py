"""Graphs for queries: a table of facts, or relational tables read as one without being converted.

A virtual graph maps a row to the subject <urn:t:table:key> and each column to <urn:t:column>; foreign keys
are IRIs of the rows they mean, other values typed literals, and NULLs make no quad. Patterns with a
constant predicate read that column alone, and patterns of one subject read one table once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import terms as T
from .expressions import Native

QUAD = ["s", "p", "o", "g"]


class Facts:
    """A graph store: s, p, o and g, null for the default graph."""

    def __init__(self, df: DataFrame):
        self.df = df.select(*QUAD)

    def quads(self, p: str | None = None) -> DataFrame:
        return self.df if p is None else self.df.where(F.col("p") == p)

    def star(self, predicates: list[str]) -> tuple[DataFrame, dict[str, Native]] | None:
        """A table of s, g and o0, o1, ... for the predicates together, or None where they must be joined.

        The second part says which of the columns have beside them, as native_s or native_o0, what the terms were made of.
        """
        return None


@dataclass
class Table:
    name: str
    df: DataFrame
    key: list[str]
    links: dict[str, str] = field(default_factory=dict)  # column -> the table that it points to

    def subject(self) -> Column:
        return F.concat(F.lit(f"<urn:t:{self.name}:"), F.concat_ws("-", *(F.col(k).cast("string") for k in self.key)), F.lit(">"))

    def predicates(self) -> dict[str, str]:
        return {f"<urn:t:{f.name}>": f.name for f in self.df.schema if not isinstance(f.dataType, (Y.ArrayType, Y.MapType, Y.StructType, Y.BinaryType))}

    def native(self, column: str | None) -> Native | None:
        """What the terms of a column, or of the subject, are made of; None where that is not kept."""
        if column is None:
            return Native("key", f"<urn:t:{self.name}:") if len(self.key) == 1 and isinstance(self.df.schema[self.key[0]].dataType, Y.IntegralType) else None
        kind = self.df.schema[column].dataType
        if column in self.links:
            return Native("key", f"<urn:t:{self.links[column]}:") if isinstance(kind, Y.IntegralType) else None
        return Native("string" if isinstance(kind, Y.StringType) else "integer" if isinstance(kind, Y.IntegralType) else "double") if isinstance(kind, (Y.StringType, Y.IntegralType, Y.DoubleType, Y.FloatType)) else None

    def object(self, column: str) -> Column:
        c, kind = F.col(column), self.df.schema[column].dataType
        if column in self.links:
            return F.when(c.isNotNull(), F.concat(F.lit(f"<urn:t:{self.links[column]}:"), c.cast("string"), F.lit(">")))
        if isinstance(kind, Y.StringType):
            return T.string(c)
        if isinstance(kind, Y.BooleanType):
            return T.typed(c.cast("string"), "boolean")
        if isinstance(kind, Y.IntegralType):
            return T.typed(c.cast("string"), "integer")
        if isinstance(kind, Y.DecimalType):
            return T.typed(T.decimal_text(c), "decimal")
        if isinstance(kind, (Y.TimestampType, Y.TimestampNTZType)):
            return T.typed(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), "dateTime")
        if isinstance(kind, Y.DateType):
            return T.typed(F.date_format(c, "yyyy-MM-dd"), "date")
        return T.typed(T.double_text(c.cast("double")), "double")


class Mapped:
    """A virtual graph over tables; every quad is in the default graph, or where graph says by table name."""

    def __init__(self, tables: list[Table], graph: Callable[[str], Column] | None = None):
        self.tables, self.graph = tables, graph or (lambda name: F.lit(None).cast("string"))

    def quads(self, p: str | None = None) -> DataFrame:
        made = []
        for t in self.tables:
            columns = {q: c for q, c in t.predicates().items() if p is None or q == p}
            if not columns:
                continue
            if p is not None:
                (column,) = columns.values()
                made.append(t.df.select(t.subject().alias("s"), F.lit(p).alias("p"), t.object(column).alias("o"), self.graph(t.name).alias("g")).where("o IS NOT NULL"))
            else:
                pairs = F.explode(F.array(*(F.struct(F.lit(q).alias("p"), t.object(c).alias("o")) for q, c in columns.items())))
                made.append(t.df.select(t.subject().alias("s"), pairs.alias("x"), self.graph(t.name).alias("g")).select("s", "x.p", "x.o", "g").where("o IS NOT NULL"))
        if not made:
            return self.tables[0].df.sparkSession.createDataFrame([], "s string, p string, o string, g string")
        return reduce(DataFrame.union, made)

    def star(self, predicates: list[str]) -> tuple[DataFrame, dict[str, Native]] | None:
        homes = [[t.name for t in self.tables if p in t.predicates()] for p in predicates]
        if any(len(h) != 1 for h in homes) or len({h[0] for h in homes}) != 1:
            return None
        t = next(t for t in self.tables if t.name == homes[0][0])
        columns = [t.predicates()[p] for p in predicates]
        places = {"s": None} | {f"o{i}": c for i, c in enumerate(columns)}
        natives = {x: n for x, c in places.items() if (n := t.native(c))}
        own = [F.col(places[x] or t.key[0]).alias(f"native_{x}") for x in natives]
        # A term is null where its column is: so said, the scan can skip these rows.
        rows = t.df.dropna(subset=list(dict.fromkeys(columns)))
        return rows.select(t.subject().alias("s"), *(t.object(c).alias(f"o{i}") for i, c in enumerate(columns)), *own, self.graph(t.name).alias("g")), natives


#: Keys and foreign keys of the test tables.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
LINKS = {
    "n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier",
}


def mapped(spark, sf_dir: str, *names: str, graph: Callable[[str], Column] | None = None) -> Mapped:
    tables = []
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        tables.append(Table(name, df, KEYS[name], {c: to for c, to in LINKS.items() if c in df.columns}))
    return Mapped(tables, graph)
