"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every window of w consecutive k-grams, with k + w - 1 = SPAN,
so each shared span of SPAN words shares a kept fingerprint; hits are extended word by word to their
full length. Items of fewer than SPAN words are windows of their own length m and use k = m, w = 1.

The test side is small as a rule: where its measured bytes are at most BOUND, its index is built once, broadcast,
and the documents are never shuffled. A larger test side is cut into blocks by hash, each of about half of BOUND or one item;
the documents are read against one block after the other, without a join on prints, so neither a print that many documents and
items share nor the number of items adds to what a task holds. Only hits are shuffled, to add up over the blocks.

The index is a handful of arrays: the items' words as one text with their places, and prints sorted by hash. It takes about
3.3 bytes for each byte of text, so about 100 MB in a worker at most (a test holds it to five).

Of equal least hashes in a window the rightmost is kept. In a text that repeats itself each place may be kept all
the same, so a print that one item holds more than TIES times is not extended from each of these places: the windows
of the document that hold it are looked up among the item's by hash and compared by bytes, which gives the same hits in time that grows with the
document alone.

Defined results: null or wordless texts have no words and no hits; null or wordless items never occur;
an item with a null id makes hits but is not listed; rows with one item id count as one item; repeated
documents each get their own row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, gram_hashes, mix, small_batches, word_hashes

SPAN, K, TIES = 10, 4, 4
W = SPAN - K + 1
BOUND = 32 << 20
CHUNK = 4 << 20
#: Word bytes are 0-9, a-z and everything from \x80; A-Z become a-z.
WORDS = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
Item = tuple[str | None, bytes]
Hits = list[tuple[int, int, str | None]]


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def sliding(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def winnow(grams: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the least hash of each window of w, the rightmost of equal ones. The hash counts by its upper half."""
    if len(grams) < w:
        return np.empty(0, dtype=np.int64)
    below = U64(0xFFFFFFFF)
    least = sliding((grams & ~below) | (below - np.arange(len(grams), dtype=U64)), w)
    return np.unique(below - (least & below)).astype(np.int64)


def short_grams(hashed: np.ndarray, m: int) -> np.ndarray:
    return mix(gram_hashes(hashed, m) ^ U64(m))


class Prints:
    """Hashes in order, each with the number of an item and a place (-1: the item holds it more than TIES times)."""

    def __init__(self, keys: list[np.ndarray], items: list[int], places: list[np.ndarray]):
        if not keys:
            keys, items, places = [np.empty(0, U64)], [0], [np.empty(0, np.int64)]
        own = np.concatenate(keys)
        item = np.repeat(np.array(items, np.int32), [len(k) for k in keys])
        order = np.argsort(own, kind="stable")  # so items and places stay in order
        self.keys, self.item, self.place = own[order], item[order], np.concatenate(places).astype(np.int64)[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (self.keys[1:] != self.keys[:-1]) | (self.item[1:] != self.item[:-1])
        run = np.cumsum(new) - 1
        many = np.bincount(run)[run] > TIES if len(own) else new
        self.place[many] = -1
        self.keys, self.item, self.place = (x[new | ~many] for x in (self.keys, self.item, self.place))
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[(self.keys >> U64(44)).astype(np.int64)] = True

    def repeating(self) -> np.ndarray:
        return np.unique(self.item[self.place < 0])

    def found(self, grams: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, item, place in the item) for those of the grams at the places that are among the prints."""
        if not len(self.keys) or not len(at):
            return
        at = at[self.near[(grams[at] >> U64(44)).astype(np.int64)]]
        low, high = (np.searchsorted(self.keys, grams[at], side=side) for side in ("left", "right"))
        for i in np.flatnonzero(low < high):
            p = int(at[i])
            for j in range(int(low[i]), int(high[i])):
                yield p, int(self.item[j]), int(self.place[j])

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.item, self.place, self.near))


class Index:
    """The test side's words and fingerprints, as arrays."""

    def __init__(self, items: list[Item]):
        self.ids = [i for i, _ in items]
        texts, sizes, first = [], [], [0]
        long: tuple[list, list, list] = ([], [], [])
        short: dict[int, tuple[list, list, list]] = {}
        for n, (_, text) in enumerate(items):
            words = split_words(text)
            first.append(first[-1] + len(words))
            if not words:
                continue
            texts.append(b" ".join(words))
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
            hashed = word_hashes(words)
            if len(words) >= SPAN:
                grams = gram_hashes(hashed, K)
                at = winnow(grams)
                to, made = long, (grams[at], n, at)
            else:
                to, made = short.setdefault(len(words), ([], [], [])), (short_grams(hashed, len(words)), n, np.zeros(1, np.int64))
            for column, x in zip(to, made, strict=True):
                column.append(x)
        self.text = b" ".join(texts)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.empty(0, np.int64)]) + 1)])
        self.first = np.array(first, np.int64)
        self.long, self.short = Prints(*long), {m: Prints(*x) for m, x in short.items()}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of items that repeat themselves: hashes in order, and places
        for n in map(int, self.long.repeating()):
            hashes = gram_hashes(word_hashes(self.run(n, 0, int(self.first[n + 1] - self.first[n])).split(b" ")), SPAN)
            order = np.argsort(hashes, kind="stable")
            self.windows[n] = hashes[order], order.astype(np.int32)

    def nbytes(self) -> int:
        return len(self.text) + self.starts.nbytes + self.first.nbytes + sum(p.nbytes() for p in (self.long, *self.short.values())) + sum(x.nbytes for w in self.windows.values() for x in w)

    def run(self, n: int, q: int, m: int) -> bytes:
        """m words of item n from place q, a space between them."""
        at = int(self.first[n]) + q
        return self.text[self.starts[at] : self.starts[at + m] - 1]

    def _has_window(self, n: int, window: bytes, hashed: np.uint64) -> bool:
        hashes, places = self.windows[n]
        i = int(np.searchsorted(hashes, hashed))
        while i < len(hashes) and hashes[i] == hashed:
            if self.run(n, int(places[i]), SPAN) == window:
                return True
            i += 1
        return False

    def _found_run(self, out: list[Hits], starts: np.ndarray, first: int, last: int, n: int) -> None:
        """Windows of item n at all places from first to last."""
        d = int(np.searchsorted(starts, first, side="right")) - 1
        out[d].append((first - int(starts[d]), last + SPAN - int(starts[d]), self.ids[n]))

    def search(self, docs: list[list[bytes]]) -> list[Hits]:
        """For each document (start, end, item id) of every maximal run that holds a window."""
        words = [w for d in docs for w in d]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        hashed = word_hashes(words)
        out: list[Hits] = [[] for _ in docs]
        reached: dict[tuple[int, int], int] = {}
        looked: dict[int, tuple[int, int, int]] = {}  # of an item that repeats itself: the run of windows found last, and where to look on
        grams = gram_hashes(hashed, K)
        spans = gram_hashes(hashed, SPAN) if self.windows else None
        for p, n, q in self.long.found(grams, winnow(grams)):
            d = int(np.searchsorted(starts, p, side="right")) - 1
            lo, hi = int(starts[d]), int(starts[d + 1])
            if q < 0:
                first, last, on = looked.get(n, (-1, -1, -1))
                for s in range(max(lo, p - W + 1, on), min(p, hi - SPAN) + 1):
                    if self._has_window(n, b" ".join(words[s : s + SPAN]), spans[s]):
                        if s != last + 1 or s == lo:
                            if last >= first >= 0:
                                self._found_run(out, starts, first, last, n)
                            first = s
                        last = s
                looked[n] = (first, last, max(on, min(p, hi - SPAN) + 1))
                continue
            if reached.get((n, p - q), -1) > p:
                continue
            size = int(self.first[n + 1] - self.first[n])
            a = 0
            while p - a > lo and q - a > 0 and words[p - a - 1] == self.run(n, q - a - 1, 1):
                a += 1
            b = 0
            while p + b < hi and q + b < size and words[p + b] == self.run(n, q + b, 1):
                b += 1
            if b >= K:
                reached[n, p - q] = p + b
                if a + b >= SPAN:
                    out[d].append((p - a - lo, p + b - lo, self.ids[n]))
        for n, (first, last, _) in looked.items():
            if last >= first >= 0:
                self._found_run(out, starts, first, last, n)
        for m, prints in self.short.items():
            grams = short_grams(hashed, m)
            for p, n, _ in prints.found(grams, np.arange(len(grams))):
                d = int(np.searchsorted(starts, p, side="right")) - 1
                if p + m <= starts[d + 1] and b" ".join(words[p : p + m]) == self.run(n, 0, m):
                    out[d].append((p - int(starts[d]), p + m - int(starts[d]), self.ids[n]))
        return out


RANGE = "array<struct<s:int,e:int>>"
RANGES = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch of about CHUNK bytes of text, or one row."""
    at, size, lengths = 0, 0, pc.binary_length(batch.column(column)).to_pylist()
    for i in range(batch.num_rows):
        size += lengths[i] or 0
        if size >= CHUNK or i == batch.num_rows - 1:
            some = batch.slice(at, i + 1 - at)
            yield some, some.column(column).to_pylist()
            at, size = i + 1, 0


def _columns(hits: list[Hits]) -> list[pa.Array]:
    return [
        pa.array([[{"s": s, "e": e} for s, e in sorted({(s, e) for s, e, _ in h})] for h in hits], RANGES),
        pa.array([sorted({i for _, _, i in h if i is not None}) for h in hits], pa.list_(pa.string())),
    ]


def _near(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in _chunks(batch, 1):
                docs = [split_words(t) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(d) for d in docs], pa.int64()), *_columns(index.value.search(docs))], names=["doc_id", "n_words", "ranges", "items"])

    return run


def _hits(index: Broadcast):
    """As _near, for the rows alone that have hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in _chunks(batch, 2):
                ranges, items = _columns(index.value.search([split_words(t) for t in texts]))
                made = pa.RecordBatch.from_arrays([some.column(0), some.column(1), ranges, items], names=["doc_id", "version", "ranges", "items"])
                yield made.filter(pc.greater(pc.list_value_length(ranges), 0))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(split_words(x.as_py())) for x in batch.column(2)], pa.int64())], names=["doc_id", "version", "n_words"])


def _items(benchmark: DataFrame) -> DataFrame:
    """The items that have a text; equal rows are one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return items.where(F.col("text").isNotNull()).dropDuplicates(["item_id", "text"])


def _blocks(items: DataFrame, bound: int, scratch: Scratch) -> Iterator[Broadcast]:
    """The index of all items, or one after the other those of blocks of them."""
    spark = items.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size <= bound:
        yield spark.sparkContext.broadcast(Index([(r.item_id, bytes(r.text)) for r in items.collect()]))
        return
    n = -(-2 * size // bound)
    own = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    dealt = scratch.write(own.repartitionByRange("block").sortWithinPartitions("block"))  # so each block is a few row groups
    for block in sorted(r.block for r in dealt.select("block").distinct().collect()):
        yield spark.sparkContext.broadcast(Index([(r.item_id, bytes(r.text)) for r in dealt.where(F.col("block") == block).collect()]))
    scratch.drop(dealt)


HITS = f"ranges {RANGE}, items array<string>"


def _by_blocks(docs: DataFrame, blocks: Iterator[Broadcast], scratch: Scratch) -> DataFrame:
    """All rows of docs with their hits, for a test side of several blocks."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    written = None
    for index in blocks:
        hits = docs.mapInArrow(_hits(index), f"doc_id long, version long, {HITS}")
        some = scratch.write(hits.groupBy("doc_id", "version").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items")))  # repeated rows have equal hits
        index.destroy()
        written = some if written is None else written.unionByName(some)
    found = written.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
    words = docs.mapInArrow(_counted, "doc_id long, version long, n_words long")
    own = words["doc_id"].eqNullSafe(found["doc_id"]) & words["version"].eqNullSafe(found["version"])
    return words.join(found, own, "left").select(words["doc_id"], "n_words", F.array_sort(F.array_distinct(F.coalesce("ranges", F.array().cast(RANGE)))).alias("ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(ranges: Column) -> Column:
    """How many places the ranges cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(state: Column, r: Column) -> Column:
        return F.struct((state["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], state["end"]))).alias("n"), F.greatest(state["end"], r["e"]).alias("end"))

    return F.aggregate(F.array_sort(ranges), start, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, n_words, n_hit, items (their ids, sorted), ranges (word ranges), contaminated: a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scratch = Scratch(spark)
    blocks = _blocks(_items(benchmark), bound, scratch)
    index = next(blocks)
    second = next(blocks, None)
    if second is None:
        found = docs.mapInArrow(_near(index), f"doc_id long, n_words long, {HITS}")
    else:
        found = _by_blocks(docs, chain([index, second], blocks), scratch)
    return found.select("doc_id", "n_words", covered(F.col("ranges")).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "ranges", (F.size("ranges") > 0).alias("contaminated"))


def _cleaned(index: Broadcast, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in _chunks(batch, at):
                yield some.filter(pa.array([not h for h in index.value.search([split_words(t.encode() if isinstance(t, str) else t) for t in texts])], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, bound: int = BOUND) -> DataFrame:
    """The rows of docs without a hit, with all their columns. What is clean of one block is written and read against the next."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    before = None
    for index in _blocks(_items(benchmark), bound, scratch):
        if before is not None:
            written = scratch.write(docs)
            if before:
                scratch.drop(*before)
            docs, before = written, [written]
        else:
            before = []
        docs = docs.mapInArrow(_cleaned(index, docs.columns.index("text")), docs.schema)
    return docs
