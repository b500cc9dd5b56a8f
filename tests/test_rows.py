"""Documents canonicalised in their rows are what merging all of their facts makes of them."""

import random

from pyspark.sql import functions as F

from quadmill.operators import facts as O
from quadmill.sources import reader

FACTS = "array<struct<s:string,p:string,o:string,g:string,src_offset:bigint>>"
TERMS = ["_:a", "_:b", "_:c0", "_:c1", "<u:x>", "u:y", "http://e/z"]
OBJECTS = [*TERMS, '"l"', '"l"@EN-us', '"l"@en-US', '"l"^^<http://www.w3.org/2001/XMLSchema#string>']


def outcomes(spark):
    rng = random.Random(5)
    row = lambda i: (rng.choice(TERMS), rng.choice(["<p:p>", "p:q"]), rng.choice(OBJECTS), rng.choice([None, None, "_:a", "<g:g>"]), i)
    facts = lambda: [row(i) for i in range(rng.choice([0, 1, 3, 12]))]
    rows = [(f"d{i // 2 if i < 20 else i}", rng.choice(["ttl", "n3"]), i % 9 > 0, [], [], facts()) for i in range(120)]
    rows.append(("large", "ttl", True, [], [], [row(i) for i in range(reader.FACTS + 50)]))
    return spark.createDataFrame(rows, f"path string, lang string, accepted boolean, warnings array<string>, errors array<string>, facts {FACTS}")


def test_rows_are_what_merging_makes(spark):
    own = outcomes(spark)
    got = sorted(map(str, reader.facts_of(own).collect()))
    # Facts of several rows of one path may share an offset, where either label is the first: those documents by their numbers alone.
    merged = O.canonicalise(reader.facts_of(own, canonical=False))
    alone = lambda rows: [r for r in rows if "'d" not in r or int(r.split("'d")[1].split("'")[0]) >= 20]
    assert len(got) > 300 and alone(got) == alone(sorted(map(str, merged.collect())))
    assert len({r.split("'")[1] for r in got}) > 60


def test_documents_are_parsed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    parsed = reader._parsed

    def counted(batches):
        for b in parsed(batches):
            seen.add(len(b))
            yield b

    monkeypatch.setattr(reader, "_parsed", counted)
    docs = spark.range(50).select(F.col("id").cast("string").alias("path"), F.lit("ttl").alias("lang"), F.lit("_:x <b:b> _:y .").alias("content"))
    assert reader.facts_of(reader.parse(docs)).count() == 50
    assert seen.value == 50
