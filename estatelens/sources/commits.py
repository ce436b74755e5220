"""Appends that happen once: rows under a key become visible with its commit, and a key is committed once.

An append writes its tables under a new attempt and then the commit, a table of one row that names
the attempt. A job that dies between the two leaves rows that no reader sees; when it is run again,
as a stream does with a batch, it writes another attempt. A key that is committed already adds
nothing. Keys have one writer at a time, as the batches of a stream do.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists

KEY = "commit_key string, attempt string"


def append(spark: SparkSession, path: str, key: str, tables: dict[str, DataFrame]) -> bool:
    """Append the rows of each table under ``key``; False if that was done before."""
    commit = f"{path}/commits/{quote(key, safe='')}"
    if exists(spark, f"{commit}/_SUCCESS"):
        return False
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.withColumns({"commit_key": F.lit(key), "attempt": F.lit(attempt)}).write.mode("append").partitionBy("commit_key", "attempt").parquet(f"{path}/{name}")
    spark.range(1).select(F.lit(key).alias("commit_key"), F.lit(attempt).alias("attempt")).coalesce(1).write.mode("overwrite").parquet(commit)
    return True


def read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The committed rows of a table, with their commit_key; empty where nothing was appended."""
    if not exists(spark, f"{path}/commits") or not exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], f"{schema}, commit_key string")
    # Spark takes two scans of a path for the same, whatever files each has seen; an option of its own keeps them apart
    now = uuid.uuid4().hex
    commits = spark.read.schema(KEY).option("recursiveFileLookup", True).option("readAs", now).parquet(f"{path}/commits")
    rows = spark.read.schema(f"{schema}, {KEY}").option("readAs", now).parquet(f"{path}/{name}")
    return rows.join(commits, ["commit_key", "attempt"], "left_semi").drop("attempt")
