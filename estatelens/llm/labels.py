"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is trained on, about, at most.
MOST_ROWS = 10_000


def remainder(parts: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``parts``; the split of rows into folds. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, in_training: Column, most: int = MOST_ROWS) -> DataFrame:
    """(text, label) of labelled documents in the training folds.

    Of each class about ``most`` rows are taken, those with the smallest hashes of their ids, so the
    sample's ids can be sent to all tasks and the texts stay where they are. Null labels and ids are
    left out; an id labelled twice the same counts once.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").distinct()
    named = named.withColumnRenamed("id", "doc_id").where(in_training)
    counts = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}  # two rows
    share = F.when(F.col("label") == 1, F.lit(most / max(1, counts.get(1, 0)))).otherwise(F.lit(most / max(1, counts.get(0, 0))))
    chosen = named.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label")
