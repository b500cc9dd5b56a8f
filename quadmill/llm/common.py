"""Helpers that several operators share: tables, lineage cuts, text hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where none is set and all run here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Written tables that cut lineage, so a lost executor never recomputes what came before them.

    ``drop`` removes a table once nothing reads it any more; what is left goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        if self.count == 1:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files.mkdirs(root)
            files.deleteOnExit(root)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bounds what a Python worker and its executor hold of a table at once; a smaller setting of the session stays."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        own = re.fullmatch(r"(\d+)b?", spark.conf.get(key) or "")
        now = int(own[1]) if own else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers: every step can be undone."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), dtype=U64, count=len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of word hashes; order counts."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    out = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * U64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out
