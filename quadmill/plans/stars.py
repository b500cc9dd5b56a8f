"""Facts laid out by characteristic sets, so that patterns of one subject are a scan.

The characteristic set of a subject (within a graph) is the set of its predicates. Subjects of one frequent set are rows of one wide table with
a column for each predicate, of which those with several values somewhere hold arrays. Patterns with constant predicates read the columns they name of
the tables that have them all; no subject is joined with itself. What is infrequent, has very many predicates or very many values of one
stays in a table of quads, where patterns are joined as usual, so that nothing is gathered without a bound and every layout gives the same answers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .expressions import Native
from .mapping import QUAD, Facts

#: Wide tables; predicates of a subject in one; values of a subject and predicate.
SETS, PREDICATES, VALUES = 64, 256, 1000


def _same_subject(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a joined with b by s and g, null graphs alike; of b only what else it has."""
    other = b.withColumnsRenamed({"s": "x_s", "g": "x_g"})
    return a.join(other, (F.col("s") == F.col("x_s")) & F.col("g").eqNullSafe(F.col("x_g")), how).drop("x_s", "x_g")


class Stars(Facts):
    """tables: of each wide table its rows (s, g, c0, c1, ...) and, by predicate, its column and whether that holds arrays; rest: other quads."""

    def __init__(self, df: DataFrame, tables: list[tuple[DataFrame, dict[str, tuple[str, bool]]]], rest: DataFrame, odd: set[str]):
        super().__init__(df)
        self.tables, self.rest, self.odd = tables, rest, odd

    @classmethod
    def of(cls, facts: DataFrame, sets: int = SETS, values: int = VALUES) -> Stars:
        """Lays facts out; the tables are written beside other working tables. Repeated quads count once, but for what very many values are.

        Facts are dealt by subject once: those that a row can hold are gathered there, and tables are made of these rows.
        """
        raw = written(facts.select(*QUAD).withColumn("key", F.xxhash64("s", "g")))
        # By hashes: subjects that share one are only taken together for larger than they are.
        cells = raw.select("key", F.xxhash64("p").alias("cell")).repartition("key").groupBy("key", "cell").count()
        sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("count").alias("most"))
        large = written(sizes.where((F.col("size") > PREDICATES) | (F.col("most") > values)).select("key"))
        others = written(raw.join(large, "key", "left_semi").select(*QUAD).distinct())
        held = raw.join(large, "key", "left_anti").groupBy("s", "g").agg(F.array_sort(F.collect_set(F.struct("p", "o"))).alias("cells"))
        predicates = lambda cells: F.array_distinct(F.transform(cells, lambda x: x["p"]))
        again = F.filter("cells", lambda x, i: (i > 0) & (F.get("cells", i - 1)["p"] == x["p"]))  # cells are sorted
        subjects = written(held.select("*", predicates("cells").alias("own")).select("s", "g", "cells", F.xxhash64("own").alias("h1"), F.xxhash64(F.lit(1), "own").alias("h2"), F.size("own").alias("size"), predicates(again).alias("several")))
        frequent = subjects.groupBy("h1", "h2", "size").count().orderBy(F.desc("count"), "h1", "h2", "size").limit(sets)
        kinds = [(i, r.h1, r.h2, r["size"]) for i, r in enumerate(frequent.collect())]
        numbers = F.broadcast(facts.sparkSession.createDataFrame(kinds, "number int, h1 long, h2 long, size int"))
        placed = subjects.join(numbers, ["h1", "h2", "size"])
        told = placed.groupBy("number").agg(F.first(predicates("cells")).alias("own"), F.array_distinct(F.flatten(F.collect_set("several"))).alias("several"))
        columns = {r.number: {p: (f"c{i}", p in r.several) for i, p in enumerate(r.own)} for r in told.orderBy("number").collect()}  # PREDICATES for each of SETS at most
        tables = []
        for number, h1, h2, size in kinds:
            own = columns[number]
            cell = lambda p: F.transform(F.filter("cells", lambda x: x["p"] == p), lambda x: x["o"])
            made = [(cell(p) if many else F.get(cell(p), F.lit(0))).alias(c) for p, (c, many) in own.items()]
            tables.append((written(subjects.where((F.col("h1") == h1) & (F.col("h2") == h2) & (F.col("size") == size)).select("s", "g", *made)), own))
        quads = lambda rows: rows.select("s", "g", F.explode("cells").alias("x")).select("s", "x.p", "x.o", "g").union(others)
        rest = written(quads(subjects.join(numbers, ["h1", "h2", "size"], "left_anti")))
        return cls(quads(subjects), tables, rest, {r.p for r in rest.select("p").distinct().limit(PREDICATES * SETS).collect()})

    def save(self, path: str) -> None:
        """Keeps the layout in a folder, from which ``load`` reads it."""
        spark = self.df.sparkSession
        self.df.write.parquet(f"{path}/quads")
        self.rest.write.parquet(f"{path}/rest")
        for i, (df, _) in enumerate(self.tables):
            df.write.parquet(f"{path}/table{i}")
        named = [(i, p, c, many) for i, (_, own) in enumerate(self.tables) for p, (c, many) in own.items()] + [(-1, p, "", False) for p in self.odd]
        spark.createDataFrame(named, "number int, p string, c string, many boolean").coalesce(1).write.parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Stars:
        own: dict[int, dict[str, tuple[str, bool]]] = {}
        for r in spark.read.parquet(f"{path}/columns").orderBy("number", "c").collect():
            own.setdefault(r.number, {})[r.p] = (r.c, r.many)
        odd = set(own.pop(-1, {}))
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("quads"), [(read(f"table{i}"), x) for i, x in sorted(own.items())], read("rest"), odd)

    def _has(self, p: str) -> bool:
        return p in self.odd or len(self.odd) >= PREDICATES * SETS

    def quads(self, p: str | None = None) -> DataFrame:
        return self.df if p is None else self.star([p])[0].select("s", F.lit(p).alias("p"), F.col("o0").alias("o"), "g")

    def star(self, predicates: list[str]) -> tuple[DataFrame, dict[str, Native]]:
        parts = []
        for df, own in self.tables:
            if not all(p in own for p in predicates):
                continue
            now = df.select("s", "g", *(F.col(own[p][0]).alias(f"o{i}") for i, p in enumerate(predicates)))
            for i, p in enumerate(predicates):
                now = now.withColumn(f"o{i}", F.explode(f"o{i}")) if own[p][1] else now.where(F.col(f"o{i}").isNotNull())
            parts.append(now)
        if all(map(self._has, predicates)) or not parts:
            one = lambda i, p: self.rest.where(F.col("p") == p).select("s", "g", F.col("o").alias(f"o{i}"))
            parts.append(reduce(lambda a, b: _same_subject(a, b, "inner"), (one(i, p) for i, p in enumerate(predicates))))
        return reduce(DataFrame.unionByName, parts), {}
