"""Packing of token sequences as vector bin packing by the dot-product heuristic.

A bin has three limits: tokens, segments and loss-bearing tokens. Bins are filled one at a time: of the
pieces that fit, the one whose demand has the largest dot product with what is left of the bin goes in
(Panigrahy et al. 2011). What no piece fits is filled by cutting one, so bins are full; each task's last
tokens are cut into sequences of power-of-two lengths, which need no padding. A task streams its
documents and holds POOL pieces of less than a sequence each, so memory is bounded, nothing is
shuffled, and sequence ids are unique by the task's number.

Which tokens bear loss is told as a part of each document's tokens, spread evenly over them; without such a column
all do, and the third limit is the first.

Defined results: a null text is an empty one, whose only id is the end mark; null ids and repeated rows
are packed like any others; a null part of loss counts as 1, others are cut to 0 to 1; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

POOL, LENGTH, SEGMENTS = 1024, 2048, 256
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def encoder(json_path: str | None = None):
    """text -> uint32 ids, as the tokenizers library gives them for byte_bpe_50k.json.

    The same vocabulary as ranks, in a faster library; texts that name the special token go to the first.
    """
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    path = json_path or public.path("byte_bpe_50k.json")
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast, plain = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), []

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            if not plain:
                plain.append(Tokenizer.from_file(path))
            return np.array(plain[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(fast.encode_to_numpy(text), dtype=np.uint32)

    return encode


class Packer:
    """Packs pieces (document number, start, length, loss) of a stream; finished bins are lists of them."""

    def __init__(self, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, pool: int = POOL):
        self.limit = np.array([length, segments, loss], dtype=np.float64)
        self.length, self.pool = length, pool
        self.demand = np.empty((0, 3))
        self.what: list[tuple[int, int]] = []
        self.total = 0

    def add(self, doc: int, tokens: int, loss: float) -> Iterator[list[tuple[int, int, int]]]:
        """loss: how many of the tokens bear loss, taken as spread evenly over them."""
        start, share = 0, loss / tokens
        whole = int(min(self.length, self.limit[2] // share if share else self.length))
        while tokens - start >= whole:
            yield [(doc, start, whole)]
            start += whole
        if start < tokens:
            self.what.append((doc, start))
            self.demand = np.vstack([self.demand, [tokens - start, 1, (tokens - start) * share]])
            self.total += tokens - start
            if len(self.what) >= self.pool:
                while len(self.what) > self.pool // 2 and self.total >= self.length:
                    yield self._bin(self.length)

    def _bin(self, length: int) -> list[tuple[int, int, int]]:
        left = self.limit.copy()
        left[0] = length
        got = []
        while left[0] >= 1 and left[1] >= 1 and len(self.what):
            fit = (self.demand <= left + 1e-9).all(axis=1)
            if fit.any():
                score = np.where(fit, self.demand @ (left / self.limit**2), -1.0)
                i = int(score.argmax())
                n = int(self.demand[i, 0])
                got.append((*self.what[i], n))
                left -= self.demand[i]
                last = len(self.what) - 1
                self.what[i], self.demand[i] = self.what[last], self.demand[last]
                self.what.pop()
                self.demand = self.demand[:last]
            else:
                i = int(self.demand[:, 0].argmax())
                share = self.demand[i, 2] / self.demand[i, 0]
                n = int(min(left[0], self.demand[i, 0], left[2] // share if share else left[0]))
                if n < 1:
                    break
                doc, start = self.what[i]
                got.append((doc, start, n))
                left -= [n, 1, n * share]
                self.what[i] = (doc, start + n)
                self.demand[i] -= [n, 0, n * share]
                if self.demand[i, 0] < 1:
                    last = len(self.what) - 1
                    self.what[i], self.demand[i] = self.what[last], self.demand[last]
                    self.what.pop()
                    self.demand = self.demand[:last]
        self.total -= sum(n for _, _, n in got)
        return got

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        while self.total > 0:
            yield self._bin(self.length if self.total >= self.length else 1 << (int(self.total).bit_length() - 1))


class Waiting:
    """Documents of which tokens are still to place. Once its full pieces are out, of a document only the tokens of the piece that waits are held."""

    def __init__(self):
        self.own: dict[int, tuple[int | None, np.ndarray, int, int]] = {}  # number -> id, the tokens held, tokens of the document, tokens to place

    def add(self, number: int, doc_id: int | None, ids: np.ndarray) -> None:
        self.own[number] = (doc_id, ids, len(ids), len(ids))

    def take(self, number: int, start: int, n: int) -> tuple[int | None, np.ndarray, int]:
        """The document's id, n of its tokens from start on, and how many it has."""
        doc_id, ids, tokens, left = self.own.pop(number)
        if left > n:
            self.own[number] = (doc_id, ids, tokens, left - n)
        at = start - (tokens - len(ids))
        return doc_id, ids[at : at + n], tokens

    def trim(self, number: int) -> None:
        if number in self.own:
            doc_id, ids, tokens, left = self.own[number]
            self.own[number] = (doc_id, ids[len(ids) - left :].copy(), tokens, left)  # places are taken from the front


def _packed(length: int, segments: int, loss: int, end: int, json_path: str | None):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(json_path), Packer(length, segments, loss)
        base, sequence, number = TaskContext.get().partitionId() << 36, 0, 0
        held = Waiting()
        rows: list[tuple] = []

        def put(bins: Iterator[list[tuple[int, int, int]]]) -> None:
            nonlocal sequence
            for pieces in bins:
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids, tokens = held.take(doc, start, n)
                    rows.append((doc_id, start, n, zlib.crc32(ids.astype("<u4").tobytes()), tokens, base + sequence, offset))
                    offset += n
                sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc_id, text, share in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end))
                held.add(number, doc_id, ids)
                put(packer.add(number, len(ids), len(ids) * share))
                held.trim(number)
                number += 1
                if len(rows) >= 10_000:
                    yield out()
        put(packer.finish())
        yield out()

    return run


def pack(docs: DataFrame, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, end: int = 1, json_path: str | None = None, loss_part: Column | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. loss_part: of a document's tokens, 0 to 1."""
    small_batches(docs.sparkSession)
    share = F.lit(1.0) if loss_part is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(loss_part.cast("double"), F.lit(1.0))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), share.alias("share"))
    return texts.mapInArrow(_packed(length, segments, loss, end, json_path), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
