"""Quality checks of generated files: line rules, manifest, placeholders, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import rulepacks as packs


# Fixed value: the strict spelling of VAL_040. Its look-ahead sees the quote that follows an id in a placeholder, so it finds these ids too.
STRICT_ID = r"customfield_\d{4,6}(?!\s*\))"


def lint(files: DataFrame, strict: bool | None = None) -> DataFrame:
    """(job_id, filename, line_no, code, severity, auto_fixed) for each line and rule that matches.

    ``strict`` says which raw field ids VAL_040 finds: those of its strict spelling (True), those outside
    of placeholders (False), or any (None), which differs from the strict spelling in ids of four digits before a bracket.
    """
    line = F.col("line")
    if strict is not None:
        raw = line.rlike(STRICT_ID) if strict else F.regexp_replace(line, packs.PLACEHOLDERS["field"], "").rlike(r"customfield_\d{4,6}")
    lines = files.select("job_id", "filename", F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    test = lambda code, p: raw if code == "VAL_040" and strict is not None else line.rlike(p)
    rules = [F.when(test(code, p), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(fix is not None).alias("auto_fixed"))) for code, sev, p, fix in packs.LINT]
    hits = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return lines.select("job_id", "filename", (F.col("at") + 1).alias("line_no"), F.explode(hits).alias("h")).select("job_id", "filename", "line_no", "h.*")


def fixed_files(files: DataFrame) -> DataFrame:
    content = F.col("content")
    for _, _, pattern, fix in packs.LINT:
        if fix is not None:
            content = F.regexp_replace(content, pattern, fix)
    return files.withColumn("content", content)


def manifest_check(files: DataFrame) -> DataFrame:
    """VAL_060 for jobs without a manifest, VAL_061 for each key that a manifest lacks."""
    is_manifest = F.col("filename") == "manifest.yml"
    jobs = files.select("job_id").distinct()
    none = jobs.join(files.where(is_manifest).select("job_id"), "job_id", "left_anti").select("job_id", F.lit("VAL_060").alias("code"), F.lit("manifest.yml").alias("missing"))
    keys = files.where(is_manifest).select("job_id", "content", F.explode(F.array(*[F.lit(k) for k in packs.MANIFEST_KEYS])).alias("missing"))
    return none.unionByName(keys.where(~F.col("content").contains(F.col("missing"))).select("job_id", F.lit("VAL_061").alias("code"), "missing"))


def placeholder_coverage(declared: DataFrame, files: DataFrame) -> DataFrame:
    """VAL_050 where a declared placeholder's file is missing, VAL_051 where the file lacks it."""
    joined = declared.join(files.select("job_id", "filename", "content"), ["job_id", "filename"], "left")
    code = F.when(F.col("content").isNull(), "VAL_050").when(~F.col("content").contains(F.col("placeholder")), "VAL_051")
    return joined.select("job_id", "filename", "placeholder", code.alias("code")).where("code IS NOT NULL")


def verdicts(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Every job: passed iff it has files and no error that was not fixed; VAL_000 counts as one."""
    have = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_files"))
    open_error = (F.col("severity") == "error") & ~F.col("auto_fixed")
    found = lint(files).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_issues"), F.count_if(open_error).alias("n_errors"), F.count_if("auto_fixed").alias("n_fixed"))
    gaps = manifest_check(files).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_manifest"))
    zero = ["n_files", "n_issues", "n_errors", "n_fixed", "n_manifest"]
    out = jobs.join(have, "job_id", "left").join(found, "job_id", "left").join(gaps, "job_id", "left").fillna(0, zero)
    errors = F.col("n_errors") + F.col("n_manifest") + F.when(F.col("n_files") == 0, 1).otherwise(0)
    return out.select("job_id", (errors == 0).alias("passed"), (F.col("n_issues") + F.col("n_manifest")).alias("n_issues"), errors.alias("n_errors"), "n_fixed")
