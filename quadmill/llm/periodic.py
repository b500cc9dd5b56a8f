"""Runs of periodic words by Karp-Miller-Rosenberg naming, without hashes or suffix sorting.

A run is a stretch of consecutive words with smallest period q and a length of max(least, 4 q) or more that can't be longer. The words
of many documents are one sequence: a word is named within its document, and an own name parts two documents, so no
stretch of two documents is ever equal to one of another. Level k names stretches of 2**k words: the pair of names of its halves, numbered
in order. Where either half stands alone its stretch does too, so few pairs are sorted from the third level on.

Candidates: a run of period q holds words that equal the ones q further on for 3 q words, so some multiple of 2 q
begins q equal words of it: its name on level floor(log2 q) is that of q words further on. One look at all multiples of 2 q for all q
of an octave is n/3 places, n log n in all. Of consecutive candidates of a run only the first goes on. Its two ends come by descending
name levels: on each level from the top, one step where the names agree. The same stretch found with several periods has
the smallest of them, of which the others are multiples, as by Fine and Wilf it is long enough for that.

Names of all levels take at most NAMES bytes or those of the 9 lowest; in texts of many million words, which have more, the top level is
stepped repeatedly and candidates compare fewer words, with the same result.

Defined results: null or wordless texts have no words and no runs; a null id is rewritten by nothing; each row is a document
of its own, repeated rows alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TIMES = 4
#: Words that are named together, and bytes of their names.
CHUNK, NAMES, LOWEST = 1 << 17, 256 << 20, 9
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Rewrite = Callable[[int | None, int], np.ndarray | None]


def levels(words: np.ndarray, longest: int, most: int) -> tuple[list[np.ndarray], bool]:
    """Names of the stretches of 1, 2, 4, ... words at each place, up to half of the longest document; whether no longer ones are shared.

    A name below len(words) is shared; len(words) + i is that of a stretch which only place i has.
    """
    n = len(words)
    alone = n + np.arange(n, dtype=np.int32 if n < 1 << 30 else np.int64)
    count = np.bincount(words, minlength=n) if n else np.empty(0, dtype=np.int64)
    out = [np.where(count[words] > 1, words, alone).astype(alone.dtype)]
    while len(out) < most and 2 << len(out) <= longest:
        half, last = 1 << (len(out) - 1), out[-1]
        here, there = last[: n - half], last[half:]
        name = alone.copy()
        at = np.flatnonzero((here < n) & (there < n))
        if not len(at):
            return out, True
        _, inverse, count = np.unique(here[at].astype(np.int64) * n + there[at], return_inverse=True, return_counts=True)
        shared = count[inverse] > 1
        if not shared.any():
            return out, True
        name[at[shared]] = inverse[shared]
        out.append(name)
    return out, False


def _equal(names: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
    """How many words from x on and from y on are equal (back: before x and before y), x below y."""
    n = len(names[0])
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        size, open_ = 1 << k, np.arange(len(x))
        while len(open_):
            step = out[open_]
            a, b = (x[open_] - step - size, y[open_] - step - size) if back else (x[open_] + step, y[open_] + step)
            fits = (a >= 0) & (b + size <= n)
            good = fits & (names[k][np.where(fits, a, 0)] == names[k][np.where(fits, b, 0)]) & fits
            open_ = open_[good]
            out[open_] += size
            if k < len(names) - 1:
                break  # two steps would have been one on the level above
    return out


def runs(words: np.ndarray, longest: int, least: int = 6, names: int = NAMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of every run, by start. words: names below their number; longest: words of the longest document."""
    n = len(words)
    nothing = np.empty(0, dtype=np.int64)
    own, all_ = levels(words, longest, max(LOWEST, names // max(1, 4 * n)))
    found = [(nothing, nothing, nothing)]
    for k in range(longest.bit_length()):
        q = np.arange(1 << k, min(2 << k, longest // TIMES + 1), dtype=np.int64)
        if not len(q) or (all_ and k >= len(own)):  # no stretch of so many words comes twice
            break
        count = np.maximum(0, n - 2 * q) // (2 * q) + 1
        ends = np.cumsum(count)
        period = np.repeat(q, count)
        x = (np.arange(ends[-1]) - np.repeat(ends - count, count)) * 2 * period
        test = min(k, len(own) - 1)
        good = x + period < n
        x, period = x[good], period[good]
        good = own[test][x] == own[test][x + period]
        x, period = x[good], period[good]
        if k + 1 < len(own):  # less those that the candidate before leads to
            above, size = own[k + 1], 2 << k
            before, near = x - 2 * period, x - size
            linked = (before >= 0) & (above[np.maximum(before, 0)] == above[np.maximum(before + period, 0)]) & (above[np.maximum(near, 0)] == above[np.maximum(near + period, 0)])
            x, period = x[~linked], period[~linked]
        start, end = x - _equal(own, x, x + period, True), x + period + _equal(own, x, x + period, False)
        long = end - start >= np.maximum(least, TIMES * period)
        found.append((start[long], end[long], period[long]))
    start, end, period = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def repeat_a_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of a tenth of the documents, by a checksum of the id, the place of the word that stands at each place instead: a tail that repeats."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def _found(rewrite: Rewrite | None, least: int):
    def finish(held: list[tuple[int | None, list[bytes], np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(w) for _, w, _ in held], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])  # a word of its own between two documents
        sequence = np.empty(begins[-1], dtype=np.int64)
        for b, (_, _, ids), size in zip(begins, held, sizes, strict=False):
            sequence[b : b + size] = ids + b
            sequence[b + size] = b + size
        start, end, period = runs(sequence, int(sizes.max(initial=0)), least)
        edge = np.zeros(begins[-1] + 1, dtype=np.int32)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, end, -1)
        gone = np.cumsum(edge) > 0
        at = np.searchsorted(start, begins)
        texts, own = [], []
        for d, (_, words, _) in enumerate(held):
            b = begins[d]
            out = gone[b : b + len(words)]
            texts.append(b" ".join(words) if not out.any() else b" ".join([words[i] for i in np.flatnonzero(~out)]))
            own.append([{"start": int(s - b), "length": int(e - s), "period": int(q)} for s, e, q in zip(*(v[at[d] : at[d + 1]] for v in (start, end, period)), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in held], pa.int64()), pa.array(sizes), pa.array(own, pa.list_(RUN)), pa.array(texts, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                if rewrite and (places := rewrite(id_, len(words))) is not None:
                    words = [words[i] for i in places]
                number: dict[bytes, int] = {}
                held.append((id_, words, np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))))
                size += len(words) + 1
                if size >= CHUNK:
                    yield finish(held)
                    held, size = [], 0
        if held:
            yield finish(held)

    return run


def periodic_runs(docs: DataFrame, least: int = 6, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start and period), collapsed: a row for each row of docs.

    docs: doc_id and text. A word of collapsed is one that no run holds after its first period. rewrite: tells, by id and number of words,
    which word stands at each place instead of the text's own.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    made = rows.mapInArrow(_found(rewrite, least), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))
