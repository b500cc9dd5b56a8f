"""Operators 11 to 13 against plain Python, with nulls, ties, repeated rows, long texts and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadmill.llm import exactdedup, fim, periodic, queries
from quadmill.llm.bits import Bits


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def frame(spark, rows, tmp_path=None):
    """Rows (doc_id, text) with columns that bear the operators' own names."""
    df = spark.createDataFrame([(i, t, "x", 1, None, "y", b"z") for i, t in rows], "doc_id long, text string, form string, n int, keep_id long, runs string, digest binary").repartition(5)
    if tmp_path is None:
        return df
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@given(st.lists(st.booleans(), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(mask):
    own = Bits(np.packbits(np.array(mask, dtype=bool), bitorder="little"))
    ones = np.flatnonzero(mask)
    assert own.total() == len(ones)
    assert own.select(np.arange(len(ones))).tolist() == ones.tolist()
    assert own.rank(np.arange(len(mask) + 1)).tolist() == [0, *np.cumsum(mask).tolist()]


def by_rule(doc_id, text):
    """What op11's contract says, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, sha(text), sha(text))
    if h[3] % 100 < 20:
        return (n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text))
    return (n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_fill_in_middle(spark, tmp_path):
    rng = random.Random(41)
    alphabet = ["a", "Zed", "é", "😀", "\n", " ", "<", "P", ">", "<P", "S>", "1", "ß", "\x00", "[", "`", "{", "@"]
    texts = [None, "", "a", "é", "<P>", "x<M>y", "<S>", "<P <S <M", "ab" * 300_000, "é" * 5000, " \t\n"] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 300))) for _ in range(400)]
    rows = [*enumerate(texts), (7, texts[7]), (7, "other"), (None, "no id at all"), (-3, "below zero")]
    got = queries.op11_fill_in_middle(spark, frame(spark, rows, tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *by_rule(i, t))) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert queries.op11_fill_in_middle(spark, frame(spark, [], tmp_path / "none")).collect() == []


def test_boundaries_over_pieces(monkeypatch):
    """Units that cross the pieces in which bytes are marked, and texts that end in a letter before one that begins with one."""
    texts = ["abc", "", "def é", "x" * 50, "yÄz", ""]
    data = "".join(texts).encode()
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for size in (8, 16, 24, 1 << 20):
        monkeypatch.setattr(fim, "PIECE", size)
        units, points = fim.boundaries(np.frombuffer(data, dtype=np.uint8), ends[:-1][ends[1:] > ends[:-1]])
        assert np.diff(units.rank(ends)).tolist() == [len(re.findall("[A-Za-z]+|[^A-Za-z]", t)) for t in texts]
        assert np.diff(points.rank(ends)).tolist() == [len(t) for t in texts]


def test_perfect_hash_is_minimal(monkeypatch):
    rng = np.random.default_rng(42)
    for n in (0, 1, 2, 63, 5000):
        for levels in (64, 1, 0):  # with few levels what is left is listed
            monkeypatch.setattr(exactdedup, "LEVELS", levels if n < 100 else 64)
            own = rng.integers(0, 1 << 63, size=(n, 4), dtype=np.uint64)
            made = exactdedup.PerfectHash.of(own)
            assert sorted(made.slots(own).tolist()) == list(range(n))
            again = exactdedup.PerfectHash(made.packed, made.sizes, made.listed)
            others = again.slots(rng.integers(0, 1 << 63, size=(100, 4), dtype=np.uint64))
            assert ((others >= -1) & (others < n)).all()


def groups_by_rule(rows):
    best = {}
    for i, t in rows:
        key = t or ""
        best[key] = max(best.get(key, (False, 0)), (i is not None, i or 0))
    count = {}
    for _, t in rows:
        count[t or ""] = count.get(t or "", 0) + 1
    return {(i, best[t or ""][1] if best[t or ""][0] else None, count[t or ""], sha(t or "")) for i, t in rows}, count


def test_exact_dedup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exactdedup, "SHARD", 16)
    monkeypatch.setattr(exactdedup, "HEAVY", 10)
    rng = random.Random(43)
    rows = [(i, f"text {rng.randrange(250)}") for i in range(500)] + [(i, "a third of all rows") for i in range(500, 800)]
    rows += [(900, None), (901, ""), (902, "Text 1"), (903, "text 1 "), (7, "text of one id"), (7, "text of one id"), (None, "text 3"), (None, "without any id"), (None, "without any id"), (905, "long " * 200_000), (2, "long " * 200_000)]
    got = queries.op12_perfect_hash_dedup(spark, frame(spark, rows, tmp_path)).collect()
    want, count = groups_by_rule(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(count) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    middle = (0 + 905) // 2
    old = {sha(t or "") for i, t in rows if i is not None and i <= middle}
    assert all(r.known == (r.text_sha256 in old) for r in got)
    docs = frame(spark, rows)
    for history in (F.lit(True), F.lit(False), F.col("doc_id") % 3 == 0):
        other = exactdedup.exact_duplicates(docs, history).select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest"))).collect()
        assert {tuple(r) for r in other} == want and len(other) == len(rows)
    assert exactdedup.exact_duplicates(frame(spark, [])).collect() == []


def runs_by_rule(words, least=6):
    """Every run: for each period the maximal stretches, and of one stretch the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 4 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed_by_rule(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs():
    """Sequences of few words, with stretches of every period planted, one document and many, few levels and all."""
    rng = random.Random(44)
    for _ in range(300):
        made = []
        for _ in range(rng.randrange(1, 6)):
            made += rng.choices(range(rng.choice([1, 2, 3, 50])), k=rng.randrange(0, 40))
            made += (rng.choices(range(3), k=rng.randrange(1, 30)) * rng.randrange(1, 9))[: rng.randrange(1, 150)]
        words = np.unique(made, return_inverse=True)[1]
        want = runs_by_rule(made)
        for names in (periodic.NAMES, 0):
            s, e, q = periodic.runs(words.astype(np.int64), len(words), 6, names)
            assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == want


def test_runs_with_few_levels(monkeypatch):
    monkeypatch.setattr(periodic, "LOWEST", 1)
    test_runs()
    monkeypatch.setattr(periodic, "LOWEST", 3)
    test_runs()


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_periodic_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 700)
    rng = random.Random(45)
    word = lambda: "".join(rng.choices("ab", k=rng.randrange(1, 4)))
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "a " * 6, "a " * 5, "x y x y " * 4, "same " * 4000, "to be or not " * 50 + "end"] + [" ".join(word() for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    rows = [*enumerate(texts), (5, texts[5]), (5, "b " * 9), (None, "c d " * 5), (None, None)]
    got = queries.op13_periodic_runs(spark, frame(spark, rows, tmp_path)).collect()
    want = []
    for i, t in rows:
        words = rewritten(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        found = runs_by_rule(words)
        top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((i, len(found), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(collapsed_by_rule(words, found))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.n_runs > 0 for r in got) > 20
    assert queries.op13_periodic_runs(spark, frame(spark, [], tmp_path / "none")).collect() == []


def test_long_text_of_runs():
    """A million words, half of them one run: seconds, not a square."""
    rng = np.random.default_rng(46)
    head = rng.integers(0, 5000, size=500_000)
    words = np.concatenate([head, np.tile(rng.integers(5000, 9000, size=1000), 500)])
    s, e, q = periodic.runs(np.unique(words, return_inverse=True)[1].astype(np.int64), len(words))
    assert (500_000, 1_000_000, 1000) in set(zip(s.tolist(), e.tolist(), q.tolist(), strict=True))
