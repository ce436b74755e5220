"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch of whole texts, about, at most; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, read by Spark from wherever ``sf_dir`` points."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let_workers_import(spark: SparkSession) -> None:
    """Put the repository on the Python workers' path (they import the operators' modules)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def batches_by_bytes(spark: SparkSession) -> None:
    """Let bytes bound the Arrow batches of whole texts, unless the session has a bound of its own.

    Spark's own bound of 64 MB is reserved several times over for each task, in the executor and its Python worker.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH_BYTES)


def give_back() -> None:
    """Return what Arrow holds but no longer uses: an idle Python worker keeps it else, beside the executor's next stage."""
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where every
    task sees the driver's disk, may do without: then a temporary folder is made once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="estatelens-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def stored(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder; the folder of the new table."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def numbered(docs: DataFrame) -> DataFrame:
    """Add ``_at`` and ``_row``: ``_at`` rises in the order of the rows of ``docs``, ``_row`` differs for each row of this reading.

    A stored table's order is that of its files, by the number that Spark gives them, and of the rows
    in each; Spark itself reads files by size. Files of other names count as the first one. A table
    that is not read from files has the order of its partitions.
    """
    row = F.monotonically_increasing_id()
    number = lambda p: F.coalesce(F.regexp_extract("_metadata.file_name", p, 1).try_cast("long"), F.lit(0))
    # 23 bits for the file, 12 for its turn where a task wrote several, 28 for the row
    file = F.shiftleft(number(r"^part-(\d+)"), 40) + F.shiftleft(number(r"-c(\d+)\."), 28)
    try:
        return docs.withColumns({"_at": file + F.col("_metadata.row_index"), "_row": row})
    except AnalysisException:  # not a file's row, or one of several files'
        return docs.withColumns({"_at": row, "_row": row})


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, size: int | None, each: int = 64 << 20) -> int:
    """Tasks for ``size`` bytes: no fewer than the session's, and so many that each has ``each`` bytes at most, about."""
    return max(8, parallelism(spark), -(-(size or 0) // each))


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], weight: Column, name: str, buckets: int | Column) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the same key before each row, without gathering a key in one task.

    Rows are dealt to ``buckets`` by a hash of ``order``; what stands before a row are its key's
    rows in lower buckets, and those before it in its own bucket. Buckets hold about
    ``rows / buckets`` rows of a key, however large the key. Where the whole key must follow
    ``order``, ``buckets`` is a column of whole numbers that rises with it. Rows that are equal in ``order``
    share a bucket and follow one another in any order. No key may be null, and ``df`` must give
    the same rows each time it is read (materialise it first when it does not).
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    bucket = buckets if isinstance(buckets, Column) else F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    dealt = df.withColumns({"_bucket": bucket, "_weight": weight})
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_place", F.coalesce(F.sum("_weight").over(place), F.lit(0)))
    # the same keys as the window's, so the join moves the rows no second time
    joined = placed.join(offsets.withColumnsRenamed({k: f"_{k}" for k in [*keys, "_bucket"]}), [placed[k] == F.col(f"_{k}") for k in [*keys, "_bucket"]], "left")
    return joined.select(*[placed[c] for c in df.columns], (F.col("_offset") + F.col("_place")).cast("long").alias(name))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str | Column], name: str, buckets: int | Column) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in buckets, as ``running_sum`` of ones."""
    return running_sum(df, keys, order, F.lit(1), name, buckets)
