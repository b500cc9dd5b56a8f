"""Nulls, ties, repeated rows, very long texts and clashing names; recall; queries against brute force."""

import itertools
import math
import pickle
import random
import sys
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quadmill.llm import decontam, langid, linededup, maxscore, minhash, packing, quality, queries, sharding
from test_operators import CHAT, ODD, conversations, docs, prose, windows_hit


def test_recall_of_links():
    """Of 10,000 pairs at 0.80 to 0.85 none is lost, by its bands or by the longer signature."""
    rng = np.random.default_rng(21)
    lost = 0
    for _ in range(10_000):
        n = int(rng.integers(20, 120))
        union = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64))
        share = rng.uniform(0.80, 0.85)
        both = int(np.ceil(share * len(union)))
        apart = len(union) - both
        x, y = np.sort(union[: both + apart // 2]), np.sort(np.concatenate([union[:both], union[both + apart // 2 :]]))
        one, two = minhash.signature(x, minhash.FINE), minhash.signature(y, minhash.FINE)
        band = (minhash.band_keys(one[: minhash.COORDINATES]) == minhash.band_keys(two[: minhash.COORDINATES])).any()
        fine = [(s >> np.uint32(8)).astype(np.uint8) for s in (one, two)]
        enough = lambda k: k * (0.8 - minhash.SIGMAS * np.sqrt(0.16 / k))
        agree = [(fine[0][:k] == fine[1][:k]).sum() >= enough(k) for k in (minhash.COORDINATES, minhash.FINE)]
        lost += not (band and all(agree))
    assert lost == 0


def test_heavy_classes(spark, monkeypatch):
    """Equal texts that hold most rows meet by a broadcast, with the same result."""
    rng = random.Random(22)
    rows = [(i, "the same words in every one of these texts") for i in range(60)] + [(100 + i, prose(rng, 20)) for i in range(20)] + [(200, "the same words in every one of these texts too")]
    want = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), 2, 80).collect()}
    monkeypatch.setattr(minhash, "HEAVY", 2)
    assert {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), 2, 80).collect()} == want
    assert all(want[i] == (0, i == 0) for i in range(60)) and want[200] == (0, False)


def test_one_of_each_group(spark):
    """An id with several texts doesn't speak for all of them."""
    a, b = prose(random.Random(1), 50), prose(random.Random(2), 50)
    rows = [(1, a), (5, a), (5, b), (7, b + " w1"), (7, b + " w1"), (8, b + " w1"), (None, a), (9, None), (10, "")]
    got = sorted(((r.doc_id, r.text) for r in minhash.keep_one(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, a), (8, b + " w1"), (None, a), (9, None), (10, "")], key=str)
    assert minhash.keep_one(docs(spark, rows)).columns == docs(spark, rows).columns
    plain = [(1, a), (2, a + " w1"), (3, b)]
    assert {r.doc_id for r in minhash.keep_one(docs(spark, plain)).collect()} == {1, 3}


def test_stages_leave_other_columns_alone(spark):
    """Columns named as those within come back as they were, beside an id with several texts too."""
    a, b = prose(random.Random(3), 60), prose(random.Random(4), 60)
    rows = [(1, a), (2, a + " w1"), (3, b), (3, a), (4, "short text of few words"), (None, b)]
    names = ["_own", "own", "_id", "_gone", "_hit", "_version", "row", "kept", "dropped", "version"]
    frame = spark.createDataFrame([(i, t, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([("x", prose(random.Random(5), 30)), ("y", " ".join(b.split()[5:25]))], "item_id string, text string")
    whole = {tuple(r) for r in frame.collect()}
    near = minhash.keep_one(frame)
    assert near.columns == frame.columns and {r.doc_id for r in near.collect()} == {1, 3, 4, None}
    for bound in (decontam.BOUND, 700):
        clean = decontam.keep_clean(frame, bench, bound)
        assert clean.columns == frame.columns and sorted((r.doc_id for r in clean.collect()), key=str) == [1, 2, 3, 4]
        assert {tuple(r) for r in clean.collect()} <= whole
    assert {tuple(r) for r in near.collect()} <= whole
    cut = linededup.dedup_lines(frame).select(*frame.columns).collect()
    assert {tuple(r) for r in cut} == whole
    model = langid.fit(frame.withColumn("lang", F.lit("en")), F.lit(True))
    assert {tuple(r) for r in langid.keep_identified(frame, model).collect()} <= whole


def test_huge_components(spark):
    """Finite components of any size: exact sums, and the nearest long for what is beyond."""
    rng = random.Random(32)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(40)] + [(40, [1e20, 0.0, 1.0, 2.0]), (41, [-1e308, 1e308, 0.0, 0.0]), (42, [1e15, -1e15, 0.5, 0.25]), (43, [float(1 << 40), 1.0, 0.0, 0.0]), (44, [5e-324, 1e300, 0.0, -1.0]), (45, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    scaled = lambda v: [int(x) if abs(x) >= 1 << 53 else math.floor(x) for x in (max(-sys.float_info.max, min(sys.float_info.max, 256 * y)) for y in v)]
    want = set()
    for q, x in rows:
        if q % 5 == 0 and x:
            scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(scaled(x), scaled(y), strict=True)))), c) for c, y in rows if c != q and y]
            want |= {(q, r, c, s) for r, (s, c) in enumerate(sorted(scores, key=lambda z: (-z[0], z[1]))[:5], 1)}
    assert {tuple(r) for r in maxscore.top_k(frame, F.col("vec_id") % 5 == 0, 5).collect()} == want


def test_texts_of_one_id_keep_their_links(spark):
    """An id with two texts of different groups ties both, whichever of its texts is looked at."""
    one, two = prose(random.Random(33), 80), prose(random.Random(34), 80)
    rows = [(5, one), (5, two), (1, one + " w1"), (2, two + " w2"), (3, one + " w3"), (4, two + " w4"), (9, prose(random.Random(35), 80))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 2, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}


def test_waiting_tokens_are_few():
    """A thousand long documents wait with less than a sequence each."""
    packer, held, taken = packing.Packer(), packing.Waiting(), {}
    rng = np.random.default_rng(31)

    def put(bins):
        for pieces in bins:
            for number, start, n in pieces:
                doc_id, ids, tokens = held.take(number, start, n)
                assert doc_id == -number and len(ids) == n and (ids == (np.arange(start, start + n) + number)).all()
                taken[number] = taken.get(number, 0) + n
                assert taken[number] <= tokens

    sizes = [int(rng.integers(1, 100_000)) for _ in range(1000)]
    for number, size in enumerate(sizes):
        held.add(number, -number, np.arange(size) + number)
        put(packer.add(number, size, size))
        held.trim(number)
        assert all(len(ids) < packing.LENGTH and ids.base is None for _, ids, _, _ in held.own.values())
    put(packer.finish())
    assert not held.own and [taken[i] for i in range(1000)] == sizes


def test_lines_over_many_partitions(spark):
    """A line that fills many ranges, and columns named as those within; the stream's sort stays in the plan."""
    rng = random.Random(23)
    hot, own = "This line stands in every document of the table, and more than once", lambda: prose(rng, 12)
    rows = [(i % 300, "\n".join([hot, own(), hot.upper() + " ", own()])) for i in range(320)]
    frame = spark.createDataFrame([(i, t, True, "n", 1) for i, t in rows], "doc_id long, text string, dropped boolean, _dropped string, version int").repartition(7)
    got = linededup.dedup_lines(frame, 40, 5).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"dropped", "_dropped", "version", "_kept"}
    assert all((r._n_lines, r._n_dropped) == (4, 0 if r.doc_id == 299 else 2) and r._dropped == "n" and r.dropped for r in got)
    assert all((hot in r._kept) == (r.doc_id == 299) for r in got)
    plan = linededup.occurrences(linededup.line_rows(frame, 40))._jdf.queryExecution().toString()
    assert "Window" in plan and "SortMergeJoin" not in plan


def test_repetitive_texts(spark):
    """Words that repeat meet items that repeat: the same hits, in time that grows with the text alone."""
    rng = random.Random(24)
    items = [("1", "no " * 900), ("2", "yes no " * 300), ("3", "a b c d e f g h i j k"), ("4", "no " * 15 + "end"), ("5", prose(rng, 30))]
    rows = [(1, "no " * 40 + "yes " + "no " * 12), (2, "x " + "yes no " * 30), (3, "no " * 9), (4, "no " * 30 + "end a b c d e f g h i j"), (5, items[4][1] + " no" * 11), (6, prose(rng, 200))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for bound in (decontam.BOUND, 700):
        got = {r.doc_id: (r.n_words, r.n_hit, set(r["items"])) for r in decontam.contamination(docs(spark, rows), bench, bound).collect()}
        assert got == {i: windows_hit(t, items) for i, t in rows}
    index = decontam.Index([("1", b"no " * 20_000)])
    (hits,) = index.search([[b"no"] * 200_000])
    assert hits == [(0, 200_000, "1")]
    a, b = rng.choices("ab", k=300), rng.choices("ab", k=300)
    two = decontam.Index([("t", " ".join(a).encode())]).search([[x.encode() for x in b]])[0]
    assert {p for s, e, _ in two for p in range(s, e)} == {p for i in range(291) if any(a[j : j + 10] == b[i : i + 10] for j in range(291)) for p in range(i, i + 10)}


def test_many_levels(spark, monkeypatch):
    """Bundles of bundles, repeated rows and heavy groups: still one shard for equal texts, near-equal bytes and gapless slots."""
    monkeypatch.setattr(sharding, "PART", 40)
    monkeypatch.setattr(sharding, "MOST", 200)
    rng = random.Random(25)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(900)] + [(5, "twice")] * 40 + [(None, "none")] * 30 + [(i, "copy") for i in range(2000, 2200)] + [(3000, None), (3001, "")]
    got = sharding.shard(docs(spark, rows), 8).collect()
    assert len(got) == len(rows)
    home: dict = {}
    for r in got:
        assert home.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    by = [[r for r in got if r.shard == k] for k in range(8)]
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by)
    sums = [sum(r.size for r in own) for own in by]
    assert max(sums) - min(sums) <= 0.02 * max(sums)


def by_hand(model, text):
    """The sizes that the classifier compares, from zstandard alone."""
    how = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **langid.PARAMETERS)
    made = langid.words(text)
    out = {}
    for lang, (data, pads) in model.items():
        one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
        size = lambda x, one=one: len(one.compress(x))
        pieces = [made[i : i + langid.PIECE] for i in range(0, len(made), langid.PIECE)]
        turns = math.ceil(langid.PADS / len(pieces))
        after = itertools.cycle(pads)
        out[lang] = sum(size(p + b" " + x) - size(p) for x in pieces for p in itertools.islice(after, turns)) / turns
    return out


def test_language_by_hand(spark):
    rng = random.Random(26)
    parts = {"aa": ["ka", "ro", "ti"], "bb": ["zu", "mel", "ong"], "cc": ["ing", "the", "st"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(2, 200)), lang) for i, lang in enumerate(list(parts) * 30)] + [(500, text("bb", 60_000), "bb"), (501, None, "aa"), (501, "", None), (502, "7 !", "aa")]
    rows += [rows[3]] * 3
    frame = spark.createDataFrame([(*r, "x", 0.5, True) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, rejected boolean")
    model = langid.fit(frame, F.col("doc_id") % 4 != 2)
    got = langid.identify(frame, model, F.col("doc_id")).collect()
    assert len(got) == len(rows)
    told = {(r.n, r.lang_pred, r.score, r.rejected) for r in got}
    assert len([x for x in told if x[0] == 3]) == 1
    for i, t, _ in rows:
        if t and any(c.isalpha() for c in t):
            sizes = by_hand(model, t)
            assert next(r.lang_pred for r in got if r.n == i) == min(sizes, key=lambda x: (sizes[x], x))
        else:
            assert {(r.lang_pred, r.score, r.rejected) for r in got if r.n == i} == {("und", 0.0, True)}
    same = {"bb": model["aa"], "aa": model["aa"]}
    assert {r.lang_pred for r in langid.identify(frame.where("doc_id < 40"), same, F.col("doc_id")).collect()} == {"aa"}
    assert langid.keep_identified(frame, model).columns == frame.columns


def test_rules_as_columns(spark):
    """The compiled column says what the rules say."""
    rng = np.random.default_rng(27)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.6) | (x[:, 5] < 0.2)).astype(float)
    model = quality.fit_rules(x, y)
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *quality.STATISTICS])
    got = [r[0] for r in frame.orderBy("i").select(model.score()).collect()]
    want = 1 / (1 + np.exp(-(quality.holds(model.rules, x) @ np.array(model.weights) + model.base)))
    assert model.rules and np.allclose(got, want)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(1, 1), (None, None)], "doc_id long, quality int")
    for rows in ([], ODD):
        frame = spark.createDataFrame([(i, t, 0.1, 2) for i, t in rows], "doc_id long, text string, upper double, y int")
        got = quality.scored(frame, quality.fit(frame, labels, "quality", F.lit(True))).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 4}) <= 1
    none = labels.where("false")
    assert {r.score for r in quality.scored(docs(spark, ODD), quality.fit(docs(spark, ODD), none, "quality", F.lit(True))).collect()} == {0.5}


def test_top_k_of_odd_rows(spark):
    rng = random.Random(28)
    rows = [(i, [float(rng.randrange(-3, 3)) for _ in range(6)], 1, "x") for i in range(200)]
    kind = "vec_id long, embedding array<double>, shard int, v string"
    assert maxscore.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") < 0, 5).count() == 0
    whole = {i: np.floor(256 * np.array(v)) for i, v, *_ in rows}
    got = maxscore.top_k(spark.createDataFrame(rows + rows[:3], kind), F.col("vec_id") % 50 == 0, 5).collect()
    assert len(got) == 20
    for r in got:
        assert r.score == int(whole[r.query_id] @ whole[r.vec_id])
    # Sums beyond 53 bits are exact, beyond 63 the nearest long.
    big = [(0, [2.0**22, 1.0], 0, ""), (50, [2.0**23 + 0.5, 1.0], 0, ""), (51, [2.0**23 + 0.5, 1.0 + 2**-8], 0, "")]
    got = maxscore.top_k(spark.createDataFrame(big, kind), F.col("vec_id") == 0, 2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(51, 2**30 * (2**31 + 128) + 256 * 257), (50, 2**30 * (2**31 + 128) + 256 * 256)]
    beyond = [(0, [2.0**40, 1.0], 0, ""), (1, [2.0**40, 1.0], 0, "")]
    assert [tuple(r) for r in maxscore.top_k(spark.createDataFrame(beyond, kind), F.col("vec_id") == 0, 2).collect()] == [(0, 1, 1, (1 << 63) - 1)]


def test_repeated_rows_are_packed(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "x"), (2, None)]
    got = packing.pack(docs(spark, rows)).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 2 * next(r.doc_tokens for r in got if r.doc_id == 1)
    assert sum(r.length for r in got if r.doc_id == 2) == 1


def stage(spark, tmp_path, name, rows):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "e", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _kept string, _n_dropped int")
    spark.createDataFrame([(1, "a b c d e f g h i j"), (None, None), (2, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    made = dict(corpus_pipeline.STAGES)[name](spark, frame, str(tmp_path))
    return frame, made


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("rows", [[], ODD + [(9, "A b c d e f g h i j k")] * 2])
def test_stages_on_odd_rows(spark, tmp_path, name, rows):
    frame, made = stage(spark, tmp_path, name, rows)
    got = made.collect()
    if not rows:
        assert not got
    elif name == "packing":
        assert len({r.doc_id for r in got}) == len({i for i, _ in rows})
    else:
        assert set(frame.columns) == set(made.columns)
        ids = [r.doc_id for r in got]
        want = {"language_id": None, "line_dedup": [i for i, _ in rows], "minhash_near_dedup": [i for i, _ in ODD if i != 4] + [4, 9], "decontamination": [i for i, _ in ODD]}[name]
        assert want is None or sorted(ids, key=str) == sorted(want, key=str)
        assert want is not None or not {2, 3} & set(ids)


def test_op5_recovers_roles(spark, tmp_path):
    """The query over a table without markers of its own."""
    rng = random.Random(29)
    rows = conversations(rng, 120, 0, most=4)
    spark.createDataFrame(rows, CHAT).drop("marker").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op5_hmm_chat_format(spark, str(tmp_path)).collect()
    want = {(c, t): (role, len(text)) for c, t, role, text, _ in rows}
    assert sum(want.get((r.conv_id, r.n)) == (r.role, r.n_chars) for r in got) / len(want) > 0.9


@pytest.mark.parametrize("name", ["op3_rule_ensemble_quality", "op6_karmarkar_karp_shards", "op7_compression_language_id", "op8_vector_bin_packing"])
def test_queries_without_sql(spark, name):
    """The queries that SQL can't express, on the smallest tables, against what their contracts say."""
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = queries.QUERIES[name](spark, data).collect()
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    if name.startswith("op8"):
        encode = packing.encoder()
        for r in rows:
            ids, own = np.append(encode(r.text or ""), np.uint32(1)), sorted((x for x in got if x.doc_id == r.doc_id), key=lambda x: x.start)
            assert [x.start for x in own] == [0, *itertools.accumulate(x.length for x in own)][:-1] and sum(x.length for x in own) == len(ids)
            assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].astype("<u4").tobytes()) for x in own)
        return
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    if name.startswith("op6"):
        text = {r.doc_id: (r.text or "").encode() for r in rows}
        assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in got)
        assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(8))
    elif name.startswith("op7"):
        lang = {r.doc_id: r.lang for r in rows}
        held = [r for r in got if r.held_out]
        assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
        assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.9
    else:
        label = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
        held = [r for r in got if r.held_out and r.doc_id in label]
        assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.8


def test_index_of_many_items_is_small():
    """What a worker holds of the test side: arrays of at most five bytes for each byte of text, though every item repeats itself."""
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(3000)]
    items = [(str(i), " ".join(rng.choices(words, k=3000) + ["so it goes on"] * 20).encode()) for i in range(120)]
    index = decontam.Index(items)
    size = sum(len(t) for _, t in items)
    assert size > 2_000_000 and index.nbytes() < 5 * size + 16 * (1 << 20)
    assert len(pickle.dumps(index)) < 5 * size + 16 * (1 << 20)
    own = items[7][1].split()
    (hits,) = index.search([[b"before"] + own[100:140] + [b"after"]])
    assert hits == [(1, 41, "7")]


def test_blocks_of_items(spark):
    """A test side over the bound is read in blocks: hits of several blocks add up, repeated rows and null ids are rows of their own."""
    rng = random.Random(32)
    items = [(None if i == 3 else str(i % 50), prose(rng, 40)) for i in range(60)] + [("one", "alpha beta")] * 30
    rows = [(None if i % 9 == 0 else i % 40, " ".join(t for _, t in rng.sample(items, i % 4)) + f" w{i % 30} x") for i in range(120)] * 2 + [(5, None), (None, "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame = docs(spark, rows)
    whole, parts = (sorted(map(str, decontam.contamination(frame, bench, bound).collect())) for bound in (decontam.BOUND, 4000))
    assert len(whole) == len(rows) and whole == parts
    clean, kept = (sorted(map(str, decontam.keep_clean(frame, bench, bound).collect())) for bound in (decontam.BOUND, 4000))
    assert clean == kept and 0 < len(clean) < len(rows)
