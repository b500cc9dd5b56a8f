"""A corpus pipeline over ``documents``: each stage works on all that the one before kept.

STAGES names them in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of documents, in their order and whatever their names: no stage
has a name of its own among them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmill.llm import decontam, langid, linededup, minhash, packing
from quadmill.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model is learned from the labels of a bounded sample of them.

    Null texts and texts without a letter go, as do all where nothing can be learned (no label, or but null ones). Repeated rows fare alike; of
    equally good languages the smaller name counts, and its lead of nothing is rejected. Rows with a null id are judged but not learned from.
    """
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that five or more of them share, save in the largest id that holds them.

    Null and empty texts stay as they are. Rows with one id are one document; those with a null id keep all lines and count for no line.
    n_chars follows the text where lines have gone.
    """
    cut = linededup.dedup_lines(docs)
    new = {"text": F.col("_kept"), "n_chars": F.when(F.col("_n_dropped") > 0, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; documents without an id or without words stay.

    Where an id has several texts each is a document of its own, of a larger id than any other; equal rows of such an id become one.

    Copies share four fifths of their five-word shingles, the measure for whole texts (op1's contract asks for two words).
    """
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and wordless texts hold none, and null and wordless items are in none; an item with a null id counts like any other. Repeated rows and
    rows with null ids are judged by their own text. Without items all stay.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of packed sequences.

    A null or empty text is its end mark alone; null ids and repeated rows are packed like others. Which pieces share a sequence depends on the
    order in which tasks read them; each token is in exactly one piece. Columns other than doc_id and text play no part.
    """
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: SQL can express neither the compression classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        made = scratch.write(stage(spark, docs, sf_dir))
        if n:
            scratch.drop(docs)
        docs = made
    return docs
