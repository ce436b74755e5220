"""Placeholder substitution by join: literal segments and tokens, resolved and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import rulepacks as packs

ANY = "|".join(f"(?:{p.replace('(customfield', '(?:customfield').replace('([^', '(?:[^')})" for p in packs.PLACEHOLDERS.values())


def tokens(files: DataFrame) -> DataFrame:
    """(job_id, filename, at, before, token, kind, server_id): each placeholder with the text before it; a last row has the rest."""
    gaps = F.split("content", ANY, -1)
    found = F.regexp_extract_all("content", F.lit(ANY), F.lit(0))
    parts = files.select("job_id", "filename", F.posexplode(F.arrays_zip(gaps.alias("before"), found.alias("token"))).alias("at", "p")).select("job_id", "filename", "at", "p.before", "p.token")
    kind, entity = F, F
    for k, p in packs.PLACEHOLDERS.items():
        kind, entity = kind.when(F.col("token").rlike(p), k), entity.when(F.col("token").rlike(p), F.regexp_extract("token", p, 1))
    return parts.select("*", kind.otherwise(None).alias("kind"), entity.otherwise(None).alias("server_id"))


def _resolved(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """Tokens with their replacement, null where it stays unresolved."""
    m = mappings.select("kind", "server_id", "cloud_id", "status", "notes", "strategy")
    joined = tokens(files).join(m, ["kind", "server_id"], "left")
    note = F.coalesce("notes", F.lit("not needed in Cloud"))
    user = F.col("kind") == "user"
    dropped = F.col("status").isNotNull() & ((F.col("status") == "skipped") | (user & (F.coalesce("strategy", F.lit("")) == "remove")))
    comment = F.concat(F.lit("/* "), F.upper("kind"), F.when(user, " REMOVED: ").otherwise(" SKIPPED: "), "server_id", F.lit(" — "), note, F.lit(" */ "), F.when(user, "null").otherwise('""'))
    value = F.when(dropped, comment).when(F.col("status").isin("mapped", "auto-mapped") & F.col("cloud_id").isNotNull(), F.concat(F.lit('"'), "cloud_id", F.lit('"')))
    return joined.withColumn("value", F.when(F.col("token").isNotNull(), value))


def resolve(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """Files with their placeholders replaced; unmapped ones are left as they are."""
    piece = F.struct("at", F.concat("before", F.coalesce("value", "token", F.lit(""))).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "")
    return _resolved(files, mappings).groupBy("job_id", "filename").agg(whole.alias("content"))


def _stats() -> list[Column]:
    there, done = F.col("token").isNotNull(), F.col("value").isNotNull()
    return [
        F.count_if(there).alias("total"), F.count_if(there & done).alias("resolved"), F.count_if(there & ~done).alias("unresolved"),
        F.count_distinct(F.when(there & ~done, F.col("token"))).alias("distinct_unresolved"),
    ]


def resolution_stats(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per file: placeholders in all, resolved, unresolved, and distinct unresolved tokens."""
    return _resolved(files, mappings).groupBy("job_id", "filename").agg(*_stats())


def session_totals(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """The same per session; a token that several files leave open counts once among the distinct ones."""
    return _resolved(files, mappings).groupBy("job_id").agg(*_stats())
