"""Lines that arrive in files, each fact once."""

from quadmill import streaming


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.nt").write_text('<a:a> <b:b> "x" .\n<a:a>  <b:b> "y"@EN .\n<a:a> <b:b> "x" .\nbad\n')
    facts = streaming.deduplicated(streaming.stream_lines(spark, str(source)))
    query = facts.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.o for r in spark.table("seen").collect()) == ['"x"', '"y"@en']
