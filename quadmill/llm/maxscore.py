"""Exact top-k search by MaxScore over sharded, dimension-ordered postings.

A query's terms are its dimensions; a term's score bounds in a shard come from the least and largest
value there. Terms are ordered by the width of their bounds. Those at the end whose widths together
cannot lift a candidate to the present k-th score are non-essential: the others' postings are traversed
for all candidates of a block, the rest are probed a few at a time for candidates that still compete.
The longest vectors come first, so the threshold is soon near its end. Vectors are dealt out once, in shards of about SHARD components; after those of its shard, sorted behind them, a
task reads the queries and holds one at a time, so its memory is bounded and no side is broadcast. Each shard
returns a query's k best, and the shards' answers are merged.

Scores are sums of doubles while these are exact, else of 64-bit integers. Vectors with a component of WIDE or more stand apart from the
others of their shard; pairs whose sums 63 bits might not hold are summed without a limit, and a score beyond the 64-bit integers is the nearest
of these.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of
another length than the query's are no candidates; rows with the query's own id are its own and repeated queries are one; ties go to
the smaller id; a repeated row is a candidate each time; without queries or vectors the result is empty; other columns
are ignored.
"""

from __future__ import annotations

import operator
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, small_batches

SHARD, LEAST, FIRST, BLOCK, PROBE = 4 << 20, 4096, 256, 4_096, 8
EXACT, WIDE = 1 << 53, 1 << 27
LONG = (1 << 63) - 1


def search(ids: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one shard; postings: dimensions x vectors, whole numbers of one kind with the query's; low, high: of each dimension."""
    ends = low * query, high * query
    least, most = np.minimum(*ends), np.maximum(*ends)
    order = np.argsort(least - most, kind="stable")
    rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # the most that terms from i on can add
    width = np.append(np.cumsum((most - least)[order][::-1])[::-1], 0)
    floor = least.sum()
    best_ids, best = ids[:0], np.empty(0, dtype=postings.dtype)
    at = 0
    while at < len(ids):
        to = min(len(ids), at + (BLOCK if at else FIRST))  # a short block first, so that the others have a threshold
        threshold = best[k - 1] if len(best) >= k else None
        # Essential: terms before the first from which on the widths cannot reach the threshold.
        i = int(np.argmax(floor + width < threshold)) if threshold is not None and threshold > floor else len(query)
        essential = query.copy()
        essential[order[i:]] = 0
        score = essential @ postings[:, at:to]
        own = np.flatnonzero(ids[at:to] != query_id) if threshold is None else np.flatnonzero((score + rest[i] >= threshold) & (ids[at:to] != query_id))
        if i < len(query) and 8 * len(own) > to - at:
            # So many compete that their terms are fetched faster with the others' than one by one.
            score, i = score + (query - essential) @ postings[:, at:to], len(query)
            own = own[score[own] >= threshold]
        score, own = score[own], own + at
        while i < len(query) and len(own):
            some = order[i : i + PROBE]
            score = score + query[some] @ postings[np.ix_(some, own)]
            i = min(len(query), i + PROBE)
            fit = score + rest[i] >= threshold
            own, score = own[fit], score[fit]
        if len(own):
            all_ids, all_ = np.concatenate([best_ids, ids[own]]), np.concatenate([best, score])
            if threshold is None and len(all_) > 8 * k:  # what is below the k-th score can't be among them, ties can
                near = all_ >= np.partition(all_, len(all_) - k)[len(all_) - k]
                all_ids, all_ = all_ids[near], all_[near]
            top = np.lexsort((all_ids, -all_))[:k]
            best_ids, best = all_ids[top], all_[top]
        at = to
    return best_ids, best


def summed(ids: np.ndarray, postings: np.ndarray, query_id: int, query: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by sums without a limit."""
    others = np.flatnonzero(ids != query_id)
    columns = [[int(x) for x in postings[:, i]] for i in others]
    score = np.array([max(-LONG - 1, min(LONG, sum(map(operator.mul, query, c)))) for c in columns], dtype=np.int64)
    top = np.lexsort((ids[others], ~score))[:k]
    return ids[others][top], score[top]


def _searched(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, held, found = None, False, [], []
        by_length: dict[int, list[tuple]] = {}

        def build() -> None:
            """The shard's postings by length of vectors, the longest vectors first: as integers and doubles, with the bounds of each dimension."""
            ids, vectors = [i for i, _ in held], [v for _, v in held]
            lengths = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
            by_length.clear()
            wide = np.array([len(v) > 0 and np.abs(v).max() >= WIDE for v in vectors], dtype=bool)
            for n in np.unique(lengths[lengths > 0]).tolist():
                for at in (np.flatnonzero((lengths == n) & ~wide), np.flatnonzero((lengths == n) & wide)):
                    if not len(at):
                        continue
                    rows = np.stack([vectors[i] for i in at])
                    with np.errstate(over="ignore"):
                        by = np.argsort(-(rows**2).sum(axis=1), kind="stable")
                    real = np.ascontiguousarray(rows[by].T)
                    most = int(np.abs(real).max())
                    forms = [(x, x.min(axis=1), x.max(axis=1)) for x in ([real.astype(np.int64), real] if most < 1 << 62 else [real])]
                    by_length.setdefault(n, []).append((np.array([ids[i] for i in at[by]], dtype=np.int64), forms, most))
            held.clear()

        for batch in batches:
            values, offsets = batch.column(3).values.to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            for i, (own, is_query, vec_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if own != shard:
                    shard, made = own, False
                    held.clear()
                v = values[offsets[i] : offsets[i + 1]]
                if not is_query:
                    held.append((vec_id, v.copy()))
                    continue
                if not made:
                    build()
                    made = True
                for ids, forms, most in by_length.get(len(v), []):
                    bound = len(v) * most * int(np.abs(v).max())
                    if bound > LONG:
                        near, score = summed(ids, forms[-1][0], vec_id, [int(x) for x in v], k)
                    else:
                        near, score = search(ids, *forms[-1], vec_id, v, k) if bound < EXACT else search(ids, *forms[0], vec_id, v.astype(np.int64), k)
                    found.append((np.full(len(near), vec_id), near, score.astype(np.int64)))
                if len(found) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=names)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=names)

    return run


def whole(embedding: Column) -> Column:
    """256 times each component, rounded down, as doubles, which hold it exactly."""
    most = F.lit(sys.float_info.max)

    def one(x: Column) -> Column:
        scaled = F.greatest(-most, F.least(most, x.cast("double") * 256))
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # all of these are whole

    return F.transform(embedding, one)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of each query row with all other rows."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("v"), is_query.alias("is_query"))
    small_batches(vectors.sparkSession)
    n, n_values = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    tasks = parts(vectors.sparkSession)
    # As many shards as keep the tasks busy where there are vectors enough, and no larger ones than SHARD.
    shards = max(1, -(-n_values // SHARD), min(4 * tasks, n // LEAST))
    # A hash of id and vector: a repeated id doesn't fill one shard.
    candidates = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "vec_id", "v")
    queries = rows.where("is_query").dropDuplicates(["vec_id", "v"]).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "vec_id", "v")
    met = candidates.union(queries).repartition(tasks, "shard").sortWithinPartitions("shard", "is_query", "vec_id").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
