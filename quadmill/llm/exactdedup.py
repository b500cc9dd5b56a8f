"""Exact de-duplication against a history of distinct digests, by minimal perfect hashing.

The history's distinct SHA-256 digests are dealt into shards of about SHARD by a hash of the digest. A shard is one row: a
minimal perfect hash of its digests in levels of bits (BBHash, Limasset et al. 2017): on each level a digest that is
alone at its bit stays there, the others go to the next, and the rank of a digest's bit over all levels is its slot. A slot holds
the full digest, the winner's locator (id and row number) and the number of copies. New digests look up their slot,
and only where all 32 bytes agree is one a repeat; others, which the hash sends to some slot too, are no members and
are grouped among themselves.

Copies are counted and their winner told before anything is shuffled, so a text that holds a third of all rows is one row for each
task, and a shard has bounded numbers of digests on both sides whatever the rows hold. Groups of 1/HEAVY of all rows or more (HEAVY
at most) meet their rows by a broadcast, the others by a join; rows alone in their group come out of it unmatched.

Defined results: a null text is the empty text; of equal texts the row of the largest id stays, null ids being the
smallest; of several such rows just one stays, the one that was read last; ``keep_id`` is null only where a group has no id;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import U64, Bits
from .common import Scratch, mix

SHARD = 2048
HEAVY = 1000
#: Bits of a level for each digest that it gets, and levels; a digest that no level keeps (a chance below 1e-12) is listed.
GAMMA, LEVELS = 2, 64
DIGEST = 32
SLOTS = "shard long, levels binary, sizes array<int>, listed binary, digests binary, ids array<long>, rows array<long>, counts array<long>"
GROUPS = "digest binary, keep_id long, keep_row long, n long, known boolean"


def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest falls on a level; its four words are mixed with the level's number."""
    at = np.full(len(digests), level + 1, dtype=U64)
    for i in range(4):
        at = mix(at ^ digests[:, i])
    return (at % U64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct digests (rows of four 64-bit words): members get 0 to n - 1, others any of these or -1."""

    def __init__(self, levels: np.ndarray, sizes: list[int], listed: np.ndarray):
        self.bits, self.packed, self.sizes, self.listed = Bits(levels), levels, list(sizes), listed

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        left, bits, sizes = digests, [], []
        while len(left) and len(sizes) < LEVELS:
            size = -(-GAMMA * len(left) // 64) * 64
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.concatenate(bits) if bits else np.empty(0, dtype=np.uint8), sizes, left)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, dtype=np.int64)
        open_, base = np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            at = base + _places(digests[open_], level, size)
            words = self.bits.words.reshape(-1)[at >> 6]
            hit = (words >> (at & 63).astype(U64)) & U64(1) == 1
            out[open_[hit]] = self.bits.rank(at[hit])
            open_, base = open_[~hit], base + size
        for j, one in enumerate(self.listed):
            out[open_[(digests[open_] == one).all(axis=1)]] = self.bits.total() + j
        return out


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=U64).reshape(-1, 4)


def _built(shard: pa.Table) -> pa.Table:
    """One row: the perfect hash of a shard and its slots."""
    digests = _words(shard.column("digest"))
    made = PerfectHash.of(digests)
    order = np.argsort(made.slots(digests))
    ids, rows, counts = (shard.column(c).take(pa.array(order)).to_pylist() for c in ("keep_id", "keep_row", "n"))
    values = [shard.column("shard")[0].as_py(), made.packed.tobytes(), made.sizes, made.listed.tobytes(), digests[order].tobytes(), ids, rows, counts]
    types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split()[0] for x in SLOTS.split(", ")])


def _better(id_: int | None, row: int, than_id: int | None, than_row: int) -> bool:
    mark = lambda i, r: (i is not None, i or 0, r)
    return mark(id_, row) > mark(than_id, than_row)


def _looked_up(fresh: pa.Table, slots: pa.Table) -> pa.Table:
    """All groups of a shard: its slots, joined by the new digests that are their members, and those that are none."""
    held = slots.to_pylist()[0] if slots.num_rows else None
    new = fresh.select(["digest", "keep_id", "keep_row", "n"]).to_pylist()
    if not held:
        out = [(r["digest"], r["keep_id"], r["keep_row"], r["n"], False) for r in new]
    else:
        at = lambda x: np.frombuffer(x, dtype=U64).reshape(-1, 4)
        known = [[held["digests"][i * DIGEST : (i + 1) * DIGEST], *x, True] for i, x in enumerate(zip(held["ids"], held["rows"], held["counts"], strict=True))]
        made = PerfectHash(np.frombuffer(held["levels"], dtype=np.uint8), held["sizes"], at(held["listed"]))
        out = list(known)
        for r, slot in zip(new, made.slots(_words(fresh.column("digest"))).tolist() if new else [], strict=True):
            if slot >= 0 and known[slot][0] == r["digest"]:
                own = known[slot]
                own[3] += r["n"]
                if _better(r["keep_id"], r["keep_row"], own[1], own[2]):
                    own[1:3] = r["keep_id"], r["keep_row"]
            else:
                out.append((r["digest"], r["keep_id"], r["keep_row"], r["n"], False))
    columns = list(zip(*out, strict=True)) or [()] * 5
    types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in GROUPS.split(", ")])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a row number of each row; written once by the caller, as the number holds for that table alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def _distinct(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("doc_id", "row"))  # nulls are the smallest
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")).select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def index(history: DataFrame, shards: int) -> DataFrame:
    """The shards of a history (digest, keep_id, keep_row, n; digests distinct), a row each."""
    return history.select("*", _shard(shards)).groupBy("shard").applyInArrow(_built, SLOTS)


def look_up(fresh: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """Every group of the history and of fresh (both as ``index`` takes them), known where the history has its digest."""
    return fresh.select("*", _shard(shards)).groupBy("shard").cogroup(slots.groupBy("shard")).applyInArrow(_looked_up, GROUPS)


def exact_duplicates(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept, known: a row for each row of docs.

    historical: a condition on doc_id that tells rows whose digests are indexed first (none: the ids of the lower half of their range,
    which have come before the others); the result is the same whatever it is, save that known tells whose text is among them.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(digests(docs))
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    if historical is None:
        historical = F.col("doc_id") <= F.lit(((ends.low or 0) + (ends.high or 0)) // 2)
    old = F.coalesce(historical, F.lit(False))
    history, fresh = scratch.write(_distinct(rows.where(old))), scratch.write(_distinct(rows.where(~old)))
    shards = max(1, -(-max(history.count(), fresh.count()) // SHARD))
    groups = scratch.write(look_up(fresh, scratch.write(index(history, shards)), shards))
    several = groups.where("n > 1")
    heavy = F.col("n") >= max(2, -(-ends.n // HEAVY))
    hot = F.broadcast(several.where(heavy))
    met = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(groups.where("n > 1 or known").where(~heavy), "digest", "left"))
    return met.select(
        "doc_id", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.coalesce("known", F.lit(False)).alias("known"),
    )
