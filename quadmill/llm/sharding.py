"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

Equal texts are one group and go to one shard. Groups are differenced in steps, so that no task
and not the driver ever holds more than a bounded number of them: parts of about PART groups are
differenced into BUNDLES bundles each, these again while there are more than MOST of them; the last bundles'
sums, and the few groups that alone hold 1/HEAVY of all bytes or more, are differenced into the shards on the
driver (MOST plus HEAVY numbers at most). Rows of such heavy groups meet their shards by a broadcast. Rows are
numbered within a shard by hashed buckets whose offsets are summed first.

Defined results: null text has no bytes and shares the group of empty texts; null ids are put like any
others; repeated rows are rows of one group; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts

PART, BUNDLES, HEAVY, BUCKET, MOST = 50_000, 32, 4096, 20_000, 65_536


def difference(sizes: list[int], k: int) -> list[int]:
    """The subset, 0 to k - 1, of each item: the two partial partitions of largest spread are joined, oppositely ordered, until one is left."""
    parent = list(range(len(sizes)))
    # A partial partition: -spread, a tie-breaker, then its subsets as (sum, node), largest first.
    heap = [(-s, i, [(s, i)] + [(0, -1)] * (k - 1)) for i, s in enumerate(sizes)]
    if k == 1:
        return [0] * len(sizes)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        joined = []
        for (x, i), (y, j) in zip(a, reversed(b), strict=True):
            if i >= 0 and j >= 0:
                node = len(parent)
                parent.append(node)
                parent[i] = parent[j] = node
            else:
                node = max(i, j)
            joined.append((x + y, node))
        joined.sort(key=lambda t: -t[0])
        heapq.heapreplace(heap, (joined[-1][0] - joined[0][0], len(parent), joined))
    where = {node: n for n, (_, node) in enumerate(heap[0][2]) if node >= 0} if heap else {}
    out = [0] * len(parent)
    for node in range(len(parent) - 1, -1, -1):
        out[node] = where[node] if parent[node] == node else out[parent[node]]
    return out[: len(sizes)]


def _bundled(rows: pd.DataFrame) -> pd.DataFrame:
    """One part: each row's bundle."""
    keys = [c for c in rows.columns if c not in ("part", "bytes")]
    rows = rows.sort_values(["bytes", *keys], ascending=[False, *(True for _ in keys)])
    return rows.assign(bundle=rows["part"].to_numpy(np.int64) * BUNDLES + np.array(difference(rows["bytes"].tolist(), BUNDLES), dtype=np.int64)).drop(columns="part")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    groups = rows.groupBy("h", "text_crc32", "size").agg((F.count("*") * F.col("size")).alias("bytes"))
    groups = scratch.write(groups)
    n_rows = rows.count()
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    heavy = F.col("bytes") * HEAVY >= F.lit(max(1, total))
    n_parts = max(parts(spark), -(-n // PART))
    light = groups.where(~heavy).withColumn("part", F.pmod("h", F.lit(n_parts)))
    key = ["h", "text_crc32", "size"]
    bundled = scratch.write(light.groupBy("part").applyInPandas(_bundled, "h long, text_crc32 long, size long, bytes long, bundle long"))
    lowest, sums = bundled, bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
    while n_parts * BUNDLES > MOST:
        n_parts = -(-n_parts * BUNDLES // PART)
        higher = sums.select(F.col("bundle").alias("lower"), "bytes", F.pmod(F.xxhash64("bundle"), F.lit(n_parts)).alias("part"))
        higher = scratch.write(higher.groupBy("part").applyInPandas(_bundled, "lower long, bytes long, bundle long"))
        bundled = bundled.withColumnRenamed("bundle", "lower").join(higher.select("lower", "bundle"), "lower").drop("lower")
        sums = higher.groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
    sums = sums.orderBy("bundle").collect()
    alone = groups.where(heavy).orderBy("h", "text_crc32", "size").collect()
    shard_of = difference([r.bytes for r in [*sums, *alone]], shards)
    placed = spark.createDataFrame([(r.bundle, s) for r, s in zip(sums, shard_of, strict=False)], "bundle long, shard int")
    single = spark.createDataFrame([(r.h, r.text_crc32, r.size, s) for r, s in zip(alone, shard_of[len(sums) :], strict=True)], "h long, text_crc32 long, size long, shard int")
    single, assigned = F.broadcast(single), bundled.join(F.broadcast(placed), "bundle").select(*key, "shard")
    sharded = rows.join(single, key).unionByName(rows.join(single, key, "left_anti").join(assigned, key))
    # By the partition too, as rows of one id and text may be many; it is written, so buckets stay as they are.
    bucket = F.pmod(F.xxhash64("doc_id", "h", F.spark_partition_id()), F.lit(max(parts(spark), -(-n_rows // BUCKET))))
    put = scratch.write(sharded.withColumn("bucket", bucket).drop("h"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = put.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    scratch.drop(rows, groups, lowest)
    return put.withColumn("n", F.row_number().over(order)).join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
