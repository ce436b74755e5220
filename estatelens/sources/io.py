"""Readers and writers: scripts, workflow exports, page snapshots, sessions, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".groovy", ".java", ".sil", ".xml", ".txt")
UPLOAD_BYTES = 2 * 1024 * 1024
PARSER_CHARS = 50_000


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: script_id (path hash), filename, content, ingested_at."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\z", 1)
    return raw.select(F.xxhash64("_metadata.file_path").alias("script_id"), name.alias("filename"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("ingested_at"))


def read_page_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages fetched, errors): a page that was not served goes to the errors and ends nothing."""
    return split_snapshots(spark.read.parquet(path))


def split_snapshots(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    errors = pages.where(~good).select("url", "crawled_at", F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none"))).alias("error"))
    return pages.where(good), errors


# What marks a workflow export beside its root and actions.
WORKFLOW_MARKS = ("com.onresolve.jira", "com.keplerrominfo", "com.appfire.jira", "GroovyFunctionPlugin", "SILPostFunction", "<post-functions>", "<validators>", "<function type=")


def is_workflow_xml(content: F.Column) -> F.Column:
    marked = F.lit(False)
    for mark in WORKFLOW_MARKS:
        marked = marked | content.contains(mark)
    return content.contains("<workflow") & (content.contains("<action") | content.contains("<common-actions")) & marked


def read_workflow_exports(spark: SparkSession, path: str) -> DataFrame:
    files = read_scripts(spark, path)
    return files.where(is_workflow_xml(F.col("content"))).select(F.col("script_id").alias("workflow_id"), F.col("content").alias("xml"))


def reject_reasons() -> F.Column:
    """Why an upload is not analysed, null if it is: the gate's checks first, then the parser's."""
    extension = F.lower(F.regexp_extract("filename", r"(\.[^.]*)\z", 1))
    blank = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+\z", "") == ""
    return (
        F.when(~extension.isin(*EXTENSIONS), "unsupported-extension")
        .when(F.octet_length("content") > UPLOAD_BYTES, "too-large")
        .when(blank, "PARSE_001")
        .when(F.length("content") > PARSER_CHARS, "PARSE_002")
    )


def split_rejects(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scripts, rejects); a reject has the verdict red, 0, manual-rewrite."""
    marked = uploads.withColumn("reason", reject_reasons())
    rejects = marked.where("reason IS NOT NULL").select("script_id", "filename", "reason", F.lit("red").alias("level"), F.lit(0).alias("score"), F.lit("manual-rewrite").alias("target"))
    return marked.where("reason IS NULL").drop("reason"), rejects


SESSION = "session_id string, mappings array<struct<kind:string,server_id:string,cloud_id:string,status:string,notes:string>>, expires_at timestamp, corrupt string"


def export_sessions(mappings: DataFrame) -> DataFrame:
    """One JSON document per session."""
    rows = F.array_sort(F.collect_list(F.struct("kind", "server_id", "cloud_id", "status", "notes")))
    return mappings.groupBy("session_id").agg(rows.alias("mappings")).select("session_id", F.to_json(F.struct("session_id", "mappings")).alias("json"))


def import_sessions(exported: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(mappings with renewed expiry, rejected documents): bad JSON or a missing id is rejected."""
    parsed = exported.select("json", F.from_json("json", SESSION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("s"))
    good = F.col("s").isNotNull() & F.col("s.corrupt").isNull() & F.col("s.session_id").isNotNull()
    expires = F.to_timestamp(F.lit(as_of)) + F.expr("INTERVAL 24 HOURS")
    rows = parsed.where(good).select(F.col("s.session_id").alias("session_id"), F.explode("s.mappings").alias("m"), expires.alias("expires_at"))
    return rows.select("session_id", "m.*", "expires_at"), parsed.where(~F.coalesce(good, F.lit(False))).select("json")


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a new version of a table; the version that is being read is never overwritten."""
    df.write.mode("errorifexists").parquet(path)
