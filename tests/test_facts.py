"""Comparing many sides without gathering sets, against plain sets."""

import random

from pyspark.sql import functions as F

from quadmill.operators import facts as O

QUADS = "s string, p string, o string, g string"


def told_by_hand(sides):
    keys = {(s, p, g) for rows in sides.values() for s, p, _, g in rows}
    out = set()
    for s, p, g in keys:
        own = {n: frozenset(o for a, b, o, c in rows if (a, b, c) == (s, p, g)) for n, rows in sides.items()}
        for n, x in own.items():
            if 2 * sum(x == y for y in own.values()) <= len(own) and len(set(own.values())) > 1:
                out |= {("ObjectMismatch", s, p, g, n, o) for o in x} or {("FactOnlyIn", s, p, g, n, "")}
    return out


def test_diff_many(spark):
    rng = random.Random(101)
    for n in (1, 3, 4, 65):
        own = {f"v{i:02}": [(f"<s:{rng.randrange(4)}>", "<p:p>", f'"{rng.randrange(3)}"', rng.choice([None, None, "<g:g>"])) for _ in range(rng.choice([0, 3, 6]))] for i in range(n)}
        if n == 3:
            own["v02"] = own["v01"]
        frames = {k: spark.createDataFrame(rows + rows[:2], QUADS) for k, rows in own.items()}
        got = [tuple(r) for r in O.diff_many(frames).collect()]
        assert len(got) == len(set(got)) and set(got) == told_by_hand(own)


def test_a_key_of_many_objects(spark):
    many = spark.range(60_000).select(F.lit("<s:s>").alias("s"), F.lit("<p:p>").alias("p"), F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"')).alias("o"), F.lit(None).cast("string").alias("g"))
    fewer = many.where("o <> '\"77\"'")
    told = O.diff_many({"a": many, "b": fewer, "c": many})
    assert told.count() == 59_999 and {r.parser_id for r in told.select("parser_id").distinct().collect()} == {"b"}
    assert "collect_" not in told._jdf.queryExecution().toString()
    a, b = (O.fingerprints(x).first() for x in (many, fewer.union(many)))
    assert a == b and a.n == 60_000 and O.fingerprints(fewer).first().h1 != a.h1
