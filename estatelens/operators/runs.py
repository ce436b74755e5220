"""The log of crawl runs: a row for each run and batch, with the errors that it met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits

REPORT = "attempted long, succeeded long, failed long, skipped long, chunks_created long, chunks_skipped long, chunks_embedded long"
ERRORS = "url string, crawled_at timestamp, error string"


def write_crawl_run(path: str, run_id: str, batch_id: int, report: DataFrame, errors: DataFrame) -> bool:
    """Append a run's report (one row, as ``index.run_report`` gives it) and its error rows, both or neither.

    The same run and batch again, as a replayed batch of a stream comes, adds nothing: False.
    """
    columns = [c.split()[0] for c in REPORT.split(", ")]
    row = report.select(*[F.col(c).cast("long").alias(c) for c in columns])
    told = errors.select("url", F.col("crawled_at").cast("timestamp").alias("crawled_at"), "error")
    return commits.append(report.sparkSession, path, f"{run_id}|{batch_id}", {"reports": row, "errors": told})


def _named(rows: DataFrame) -> DataFrame:
    key = F.col("commit_key")
    return rows.select(F.substring_index(key, "|", -1).cast("int").alias("batch_id"), F.expr("substr(commit_key, 1, length(commit_key) - length(substring_index(commit_key, '|', -1)) - 1)").alias("run_id"), *[c for c in rows.columns if c != "commit_key"])


def crawl_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, batch_id, counts of the report, n_errors): each committed run and batch once."""
    reports, errors = _named(commits.read(spark, path, "reports", REPORT)), crawl_run_errors(spark, path)
    n = errors.groupBy("run_id", "batch_id").agg(F.count(F.lit(1)).alias("n_errors"))
    return reports.join(n, ["run_id", "batch_id"], "left").fillna(0, ["n_errors"])


def crawl_run_errors(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, batch_id, url, crawled_at, error)."""
    return _named(commits.read(spark, path, "errors", ERRORS))
