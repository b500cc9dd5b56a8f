"""Tokens against a reading of each line letter by letter, and places in characters of two UTF-16 units."""

import random
import re

from quadmill.operators import documents as D

ALNUM = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
ALPHA = ALNUM - set("0123456789")


def by_letter(lang, text):
    """(line, start, length, type, modifiers) in characters: what a line has, from left to right."""
    out = []
    for n, line in enumerate(text.split("\n")):
        line = line.removesuffix("\r")
        bare = line.lstrip(" \t\x0b\x0c\r")
        mark = "%" if lang == "datalog" else "#"
        if bare.startswith(mark) and lang in ("nt", "datalog"):
            out.append((n, 0, len(line), 7, 0))
            continue
        i = 0

        def run(k, more, line=line):
            while k < len(line) and line[k] in more:
                k += 1
            return k

        while i < len(line):
            c, start = line[i], i
            if c == mark:
                out.append((n, i, len(line) - i, 7, 0))
                break
            if c == '"' or c == "'" and lang in ("ttl", "nt"):
                i += 1
                while i < len(line) and line[i] != c:
                    i += 2 if line[i] == "\\" else 1
                i = min(i + 1, len(line))
                out.append((n, start, i - start, 4, 1))
            elif c == "<" and lang != "datalog":
                at = line.find(">", i)
                i = len(line) if at < 0 else at + 1
                out.append((n, start, i - start, 2, 0))
            elif c == "@" and lang in ("ttl", "nt", "shex"):
                i = run(i + 1, ALPHA)
                out.append((n, start, i - start, 6, 0))
            elif c in "?$" and lang == "sparql":
                i = run(i + 1, ALNUM | {"_"})
                out.append((n, start, i - start, 3, 0))
            elif lang == "datalog" and c in ALPHA:
                i = start + 3 if line.startswith("not", i) else run(i, ALNUM | {"_"})
                out.append((n, start, i - start, 3 if c.isupper() else 6 if line.startswith("not", start) else 2, 0))
            elif lang == "sparql" and c in "0123456789":
                i = run(i, set("0123456789.eE+-"))
                out.append((n, start, i - start, 5, 0))
            elif c in (ALNUM | {"_"} if lang in ("ttl", "nt") else ALPHA) and lang != "datalog":
                i = run(i, ALNUM | {"_", ":"} | (set() if lang == "sparql" else {"-"}))
                word = line[start:i]
                key = word in ("a", "true", "false") if lang in ("ttl", "nt") else word.upper() in D.SPARQL_WORDS.split() if lang == "sparql" else word in D.SHEX_WORDS.split()
                out.append((n, start, i - start, 6 if key else 0 if ":" in word else 2, 0))
            else:
                i += 1
    return out


def test_scanners_by_letter():
    rng = random.Random(111)
    words = ["a", "true", "not", "nothing", "SELECT", "select", "ASK:", "asks", "IRI", "iri", "p:q-r", ":x", "_:b", "X", "Y_1", "@en", "@", "<a:b>", "<a b", '"s"', '"a\\"b"', '"open', "'q'", "'", "\\", "?x", "$", "12", "1.5e-3", ".", ";", "(", "#", "%", "# c", "  ", "\n", "\n", "\n  # x\n", "\n% y\n", "\t", "é", "a-b", "-", "STRLEN", "e"]
    scanners = D._compiled(D.SCANNERS)
    for _ in range(1500):
        text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))
        for lang, (scanner, types, modifiers) in scanners.items():
            for plain in (None, re.compile(D.PLAIN[lang])):
                line, start, length, group, _ = D.scan(text, scanner, plain)
                assert list(zip(line.tolist(), start.tolist(), length.tolist(), types[group].tolist(), modifiers[group].tolist(), strict=True)) == by_letter(lang, text), (lang, text)


def test_delta_tokens_and_wide_characters(spark):
    texts = [("a", "ttl", 'e:a e:b "😀é" . e:c\n"😀" e:d\n\n  e:f "open 😀\ne:g'), ("b", "sparql", ""), ("c", "ttl", "# 😀 only"), ("d", "none", "x"), ("e", "ttl", None)]
    docs = spark.createDataFrame(texts, "path string, lang string, text string")
    own = [tuple(r) for r in D.delta_tokens(docs).collect()]
    assert sorted(own) == sorted(tuple(r) for r in D.delta_encoded(D.semantic_tokens(docs)).collect())
    places = {(r[0], r[1], r[2]): r[5] for r in own}
    assert places["a", 0, 8] == 5 and places["a", 0, 16] == 3 and places["a", 1, 5] == 3 and places["a", 3, 6] == 8 and places["c", 0, 0] == 9


def test_texts_scanned_together_are_scanned_apart():
    rng = random.Random(112)
    parts = ["a", "e:p", '"s\\"', "'q'", "\n", "\r\n", " ", "é", "😀", "# c", "<u:x>", "<u", "@en", "?x", "12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(400)]
    for lang, (scanner, _, _) in D._compiled(D.SCANNERS).items():
        plain = re.compile(D.PLAIN[lang])
        whose, *columns, places, whole = D.scan_all(texts, scanner, plain)
        for i, text in enumerate(texts):
            *alone, own = D.scan(text, scanner, plain)
            assert all((c[whose == i] == x).all() for c, x in zip(columns, alone, strict=True))
            assert [whole[a:b] for a, b in places[:, whose == i].T.tolist()] == [text[a:b] for a, b in own.T.tolist()]
