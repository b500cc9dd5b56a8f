"""Small documents are dealt to all tasks, and what is made of them goes out in few batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from quadmill import queries as Q
from quadmill.operators import documents as D
from quadmill.sources import reader

TEXTS = ["<a:a> <b:b> <c:c>, <c:d> .", "", "<a:a> <b:b>", "_:x <b:b> _:y .", None, "﻿<a:a> <b:b> '\U0001f600' ."]


def batch(texts, lang="ttl"):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(n)]), pa.array([lang] * n), pa.nulls(n, pa.string()), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], names=["path", "lang", "base", "content"])


def test_outcomes_share_a_batch_and_stay_apart():
    own = batch(TEXTS * 100)
    together = list(reader._parsed(iter([own.slice(0, 250), own.slice(250)])))
    alone = [b for i in range(len(own)) for b in reader._parsed(iter([own.slice(i, 1)]))]
    assert len(together) == 1
    assert pa.Table.from_batches(together).to_pylist() == pa.Table.from_batches(alone).to_pylist()
    assert [x["src_offset"] for x in together[0].column("facts")[0].as_py()] == [0, 1]


def test_batches_of_outcomes_are_bounded(monkeypatch):
    monkeypatch.setattr(reader, "DOCUMENTS", 7)
    assert [len(b) for b in reader._parsed(iter([batch(TEXTS * 3)]))] == [7, 7, 4]
    monkeypatch.setattr(reader, "CHARACTERS", 10)
    assert len(list(reader._parsed(iter([batch(TEXTS[:1] * 5)])))) == 5


def test_documents_of_one_file_are_many_tasks(spark):
    docs = spark.range(64).coalesce(1).select(F.col("id").cast("string").alias("path"), F.lit("ttl").alias("lang"), F.lit("<a:a> <b:b> 1 .").alias("content"))
    tasks = lambda df: df.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks(reader.parse(docs)) > 4
    assert tasks(D.semantic_tokens(docs.withColumn("text", F.col("content")))) > 4


def test_tokens_share_a_batch_and_stay_apart():
    for kind in ("plain", "text", "delta"):
        texts = ["<a:a> <b:b>\n 'é\U0001f600' .", "", None, "a:b 1"] * 50
        own = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(200)]), pa.array(["ttl"] * 200), pa.array(texts)], names=["path", "lang", "text"])
        together = list(D._scanned(kind)(iter([own])))
        alone = [b for i in range(200) for b in D._scanned(kind)(iter([own.slice(i, 1)]))]
        assert len(together) == 1
        assert pa.Table.from_batches(together).to_pylist() == pa.Table.from_batches(alone).to_pylist()


def test_larger_tables_make_more_documents(spark, monkeypatch):
    """Round trips write no document of more than a fixed number of rows."""
    seen, parse = [], reader.parse
    monkeypatch.setattr(reader, "parse", lambda docs: seen.append(docs) or parse(docs))
    for name in ("literal_roundtrip", "nt_roundtrip", "nq_roundtrip", "turtle_roundtrip", "trig_blocks"):
        Q.QUERIES[name](spark, "/root/testdata/sf0.01")
        statements = F.size(F.regexp_extract_all("content", F.lit(r"(?m)<urn:text>|c_name>|t:c_name "), F.lit(0)))
        assert seen[-1].agg(F.max(statements)).first()[0] <= Q.SHARED, name


def test_labels_are_not_broadcast(spark):
    """The names of blank nodes grow with the documents: no executor holds them all."""
    docs = spark.range(8).select(F.col("id").cast("string").alias("path"), F.lit("ttl").alias("lang"), F.lit("_:x <b:b> _:y .").alias("content"))
    facts = reader.facts_of(reader.parse(docs))
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 3


def test_checks_are_outcomes_without_facts(spark):
    """What an editor asks for crosses no boundary with the facts, and stays the same."""
    docs = spark.range(60).coalesce(1).select(F.col("id").cast("string").alias("path"), F.element_at(F.array(F.lit("ttl"), F.lit("sparql"), F.lit("shex")), (F.col("id") % 3 + 1).cast("int")).alias("lang"), F.element_at(F.array(*map(F.lit, ["<a:a> <b:b> 1 .", "SELECT * WHERE { ?x <a:a> ?y } GROUP BY ?x", "<u:S> { <u:p> IRI }", "<a:a>", "﻿", "\\"])), (F.col("id") % 6 + 1).cast("int")).alias("content"))
    made, checked = reader.parse(docs), reader.check(docs)
    assert "facts" not in checked.columns
    assert sorted(map(str, checked.collect())) == sorted(map(str, made.drop("facts").collect()))
    assert checked.where("accepted").count() and checked.where("NOT accepted").count()


def test_documents_dealt_before_are_not_dealt_again(spark):
    docs = spark.range(64).repartition(5).select(F.col("id").cast("string").alias("path"), F.lit("ttl").alias("lang"), F.lit("<a:a> <b:b> 1 .").alias("content"))
    for made in (reader.parse(docs, deal=False), reader.check(docs, deal=False)):
        assert made.select(F.spark_partition_id().alias("t")).distinct().count() == 5
