"""Queries 3 and 6 against the same worked out by hand: statistics and rules one by one, differencing over plain lists."""

import math
import random
import string

from quadmill.llm import quality, sharding
from quadmill.llm.common import crc_mod
from test_operators import docs, prose


def statistics_by_hand(text):
    """Byte by byte and word by word."""
    n, space = max(1, len(text)), b" \t\n\x0b\x0c\r"
    words, word = [], b""
    for c in text:
        if c in space:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([c])
    words += [word] if word else []
    lines, w = text.split(b"\n"), max(1, len(words))
    part = lambda good: sum(good(c) for c in text) / n
    marks = {ord(c) for c in string.punctuation}
    ends = set(b"'(!\"#$%&)*+,-./:;<=>?@[]^_{|}~")
    times = {x: words.count(x) for x in set(words)}
    out = [math.log(1 + len(text)), math.log(1 + len(words)), part(lambda c: 65 <= c <= 90), part(lambda c: 48 <= c <= 57), part(lambda c: c == 32), part(lambda c: c == 10)]
    out += [part(lambda c: c in marks), part(lambda c: c >= 128), (len(text) - (len(lines) - 1) - (w - 1)) / w, len(times) / w, max(times.values(), default=0) / w]
    out += [len(set(lines)) / len(lines), w / len(lines), max(map(len, words), default=0), sum(x[-1] not in ends for x in words) / w, sum(len(x) > 1 and x.isupper() for x in words) / w]
    out += [part(lambda c: c in marks) - part(lambda c: c == 46) - part(lambda c: c == 44), *(part(lambda c, s=s: c == ord(s)) for s in quality.SIGNS)]
    return out


def test_scores_by_hand(spark):
    rng = random.Random(131)
    good = [(i, prose(rng, 30) + ".") for i in range(300)]
    bad = [(i, "".join(rng.choices("|!#%&*$@<> AB\n\t.", k=rng.randrange(1, 200)))) for i in range(300, 560)]
    odd = [(900, None), (901, ""), (902, "\n \n"), (903, "é ü 😀 ÀB CD.\n"), (904, "x" * 200_000), (5, good[5][1]), (None, "WORDS IN CAPITALS, 12 of them")]
    rows = good + bad + odd
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in good + bad], "doc_id long, quality int")
    model = quality.fit(frame, labels, "quality", crc_mod("doc_id", 5) != 0)
    assert model.rules
    want = []
    for i, text in rows:
        own = statistics_by_hand((text or "").encode())
        total = model.base + sum(weight for rule, weight in zip(model.rules, model.weights, strict=True) if all((own[s] > at) if above else (own[s] <= at) for s, above, at in rule))
        want.append((i, 1 / (1 + math.exp(-total))))
    measured = {r.doc_id: list(r)[1:] for r in quality.measure(frame).collect()}
    for i, text in rows:
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(measured[i], statistics_by_hand((text or "").encode()), strict=True)), i
    got = sorted(((r.doc_id, r.score, r.predicted) for r in quality.scored(frame, model, 0.3).collect()), key=str)
    for (i, score, predicted), (j, by_hand) in zip(got, sorted(want, key=str), strict=True):
        assert i == j and math.isclose(score, by_hand, rel_tol=1e-9) and predicted == (by_hand >= 0.3)
    held = {r.doc_id: r.score for r in quality.scored(frame, model).where(crc_mod("doc_id", 5) == 0).where("doc_id < 560").collect()}
    assert sum((held[i] >= 0.5) == (i < 300) for i in held) >= 0.97 * len(held)


def differenced(sizes, k):
    """Partial partitions as lists of items: the two of largest spread are joined until one is left."""
    parts = [[[(s, i)]] + [[] for _ in range(k - 1)] for i, s in enumerate(sizes)]
    weight = lambda x: sum(s for s, _ in x)
    while len(parts) > 1:
        parts.sort(key=lambda p: max(map(weight, p)) - min(map(weight, p)))
        a, b = (sorted(parts.pop(), key=weight) for _ in range(2))
        parts.append([x + y for x, y in zip(a, reversed(b), strict=True)])
    return sorted(weight(x) for x in parts[0]) if parts else [0] * k


def test_differencing_by_hand():
    """Without ties of spread there is one answer."""
    rng = random.Random(132)
    for _ in range(200):
        k, sizes = rng.randrange(2, 6), rng.sample(range(1, 1 << 40), rng.randrange(1, 40))
        own = sharding.difference(sizes, k)
        sums = [0] * k
        for s, at in zip(sizes, own, strict=True):
            sums[at] += s
        assert sorted(sums) == differenced(sizes, k)


def test_shards_by_hand(spark):
    """Where each text alone is heavy, the shards' bytes are those of differencing the texts themselves."""
    rng = random.Random(133)
    sizes = rng.sample(range(200, 4000), 60)
    rows = [(i, "".join(rng.choices("abc ", k=n))) for i, n in enumerate(sizes)]
    rows += [(200, rows[0][1]), (201, rows[0][1])]
    got = sharding.shard(docs(spark, rows), 8).collect()
    groups: dict = {}
    for _, text in rows:
        groups[text] = groups.get(text, 0) + len(text) + 1
    by = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert sorted(by) == differenced(list(groups.values()), 8)
    assert all({r.slot for r in got if r.shard == k} == set(range(sum(r.shard == k for r in got))) for k in range(8))
