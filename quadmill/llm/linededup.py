"""Line de-duplication with DataFrame functions alone.

Lines become hashes at once. These are range-partitioned by (hash, document, largest first) and sorted by (hash,
document, position); the partition is written with them. A stream over each run of one hash in one partition tells
its first occurrence, so which document keeps the line, and counts documents as they begin. A range ends between two
documents, never within one, so the runs of a hash that spans partitions add up: such hashes are the first or last
of their partition, at most one for each border, and their sums come to every task as a table of that bound. A line
in a third of all documents is thus many runs in as many tasks.
Every document gets a bitmap of the lines to drop, as 63-bit words. The text itself is shuffled only once, to
meet its bitmap.

Defined results: a null or empty text is one empty line; rows with a null id take no part and keep all
lines; rows with one id are one document, each with a bitmap for its own text; other columns pass through
``drop_lines`` untouched, whatever their names, save that those named as a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Stripped at both ends of a line: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 63


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The stripped line, A-Z lower-cased; pure ASCII takes the faster way."""
    bare = F.trim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, version, pos) of every line whose key is long enough; version tells texts of one id apart."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    keys = cut.where((F.char_length("line") >= min_chars) & F.col("doc_id").isNotNull()).select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "version", "pos")


def occurrences(rows: DataFrame) -> DataFrame:
    """The rows with n (documents that hold the line) and first (the one that keeps it)."""
    scratch = Scratch(rows.sparkSession)
    hashes = scratch.write(rows)  # as dealing by range reads them twice
    ranged = hashes.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "version", "pos")
    rows = scratch.write(ranged.withColumn("part", F.spark_partition_id()))
    scratch.drop(hashes)
    # Two hashes a partition at most, of which only those on both sides of a border stay.
    ends = rows.groupBy("part").agg(F.array(F.min(F.struct("h1", "h2")), F.max(F.struct("h1", "h2"))).alias("ends")).select("part", F.explode(F.array_distinct("ends")).alias("end"))
    spanning = ends.groupBy("end.h1", "end.h2").count().where("count > 1").select("h1", "h2")
    whole = rows.join(F.broadcast(spanning), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_all"), F.max("doc_id").alias("first_all"))
    run = Window.partitionBy("part", "h1", "h2")
    stream = run.orderBy(F.desc("doc_id"), "version", "pos")
    begins = F.when(F.lag("doc_id").over(stream) == F.col("doc_id"), 0).otherwise(1)
    here = rows.select("*", begins.alias("begins"), F.first("doc_id").over(stream).alias("first_here")).select("*", F.sum("begins").over(run).alias("n_here"))
    met = here.join(F.broadcast(whole), ["h1", "h2"], "left")
    return met.select("doc_id", "version", "pos", F.coalesce("n_all", "n_here").alias("n"), F.coalesce("first_all", "first_here").alias("first"))


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, version, dropped): a sparse bitmap, word number -> 63 bits, of the lines to drop."""
    gone = occurrences(line_rows(docs, min_chars)).where((F.col("n") >= min_docs) & (F.col("doc_id") != F.col("first")))
    words = gone.groupBy("doc_id", "version", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    return words.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with _n_lines, _n_dropped and _kept (the text that stays, null only where the text is)."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    text, id_ = F.col("row").getField("text"), F.col("row").getField("doc_id")
    met = rows.join(bitmaps, (id_.cast("long") == F.col("doc_id")) & (F.xxhash64(text) == F.col("version")), "left")

    def stays(_: Column, i: Column) -> Column:
        word = F.element_at("dropped", F.floor(i / WORD).cast("int"))
        return word.isNull() | (F.call_function("getbit", word, (i % WORD).cast("int")) == 0)

    kept = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.filter(lines(text), stays), "\n"))
    n_dropped = F.coalesce(F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w)), F.lit(0).cast("long"))
    n_lines = F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, F.lit(1)).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    new = {"_n_lines": n_lines.cast("long"), "_n_dropped": n_dropped, "_kept": kept}
    made = met.select("row", F.struct(*(v.alias(c) for c, v in new.items())).alias("made"))  # before the names of docs are there
    return made.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *(F.col("made").getField(c).alias(c) for c in new))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs, less the lines that min_docs documents share, save in the largest doc_id that holds them."""
    return drop_lines(docs, drop_bitmaps(docs, min_chars, min_docs))
