"""Documents by statements say what they say as a whole, and an edit makes one statement be parsed."""

import random

from quadmill.operators import facts as O
from quadmill.sources import reader
from quadmill.sources.statements import reparsed, split_statements


def docs(spark, rows):
    return spark.createDataFrame(rows, "path string, content string, base string")


def told(df):
    return sorted(map(str, ((r.doc_id, r.s, r.p, r.o) for r in df.collect())))


def whole(frame):
    from pyspark.sql import functions as F

    return reader.facts_of(reader.parse(frame.withColumn("lang", F.lit("ttl"))))


def test_an_edit_parses_one_statement(spark):
    lines = [f'e:s{i} e:p "{i}." , {i}.5 ; e:q [ e:r e:s{i} ] .' for i in range(10_000)]
    head = "@prefix e: <http://e/> .\n"
    before = docs(spark, [("d", head + "\n".join(lines), None)])
    facts, known, new = reparsed(before)
    assert new.count() == 10_001 and facts.count() == 40_000
    lines[5_000:5_001] = ["# one more\n", lines[5_000].replace('"5000."', "'''changed.\n'''")]
    after = docs(spark, [("d", head + "\n".join(lines), None)])
    facts, _, new = reparsed(after, known)
    assert [bytes(r.text).decode().count("changed") for r in new.collect()] == [1]
    assert O.same_facts(facts.select("s", "p", "o", "g"), whole(after).select("s", "p", "o", "g"))


def test_random_documents(spark):
    rng = random.Random(121)
    pieces = [
        'a:x a:p "q. <r> # s" .', "a:x a:p 'it''s' .".replace("''", "\\'"), 'a:y a:p """long. "quoted" text.\n.""" , 1.5 , -2 , 3e4 , true.', "<x> <p> <../y.z> .", "[] a:p [ a:q 1 ] .", "[] a:p [ a:q 1 ] .", "_:b a:p _:b .", "_:b a a:T.", "# a comment. a:z a:p a:q .\n",
        "@prefix a: <http://other/> .", "PREFIX b: <http://b/>", "@base <http://base/dir/> .", "BASE <sub/>", "b:c a:p b:d.e .", "a:x a:p ( 1 2 \"x.\"@en ) ; a:q <y> .", ":none a:p 1 .", "a:x a:p 1.\na:y a:p 2.", "a:%2E a:p a:b\\.c .",
    ]
    rows = [(f"d{i}", "@prefix a: <http://a/> .\n" + rng.choice(["", "﻿"]) * 0 + "".join(rng.choice(pieces) + rng.choice([" ", "\n", "\n\n", "\t# c.\n"]) for _ in range(rng.randrange(1, 9))), rng.choice([None, "http://doc/x/y"])) for i in range(150)]
    rows += [("empty", "", None), ("null", None, None), ("mark", "﻿@prefix a: <http://a/> . a:x a:p a:y .", None), ("open", '@prefix a: <http://a/> . a:x a:p "no end .', None)]
    frame = docs(spark, rows)
    facts, known, new = reparsed(frame)
    assert told(facts) == told(whole(frame)) and new.count() == known.count()
    again, _, none = reparsed(frame, known)
    assert told(again) == told(facts) and none.count() == 0


def test_places():
    text = "@prefix a: <u:> .\na:x a:p 1.5 . # a: <u:> .\na:y a:p '.' ."
    assert [(text[at:][:3], own[-7:]) for at, _, own in split_statements(text)] == [("@pr", ": <u:> ."[-7:]), ("a:x", "p 1.5 ."), ("a:y", "p '.' .")]
