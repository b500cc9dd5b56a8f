"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and all tasks run here, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """The path of a folder of its own, still to be made, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)  # what isn't there can't be marked
    files.deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table of their own, which goes when the session's JVM ends."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.mode("append").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._paths = [path]
    return made


def appended(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one kind as one: a fixpoint keeps what each round adds, and never writes the whole again."""
    paths = [p for t in tables for p in t._paths]
    made = tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)
    made._paths = paths
    return made


#: Tasks for each core, where rows are dealt.
SHARES = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows over some tasks for each core, for work that is long for its bytes.

    A small file is one task's, whatever is made of its rows, and partitions told by their bytes alone are joined again; a number of them stays.
    """
    return df.repartition(SHARES * df.sparkSession.sparkContext.defaultParallelism, *keys)
