"""The dimension of crawl targets and its constraints, judged in the pass that writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a target may be.
CATEGORIES = ("forge-api", "rest-api-v3", "scriptrunner-cloud", "connect-api", "forge-manifest", "oauth-scopes", "migration-guide")
PRIORITIES = ("high", "medium", "low")
FREQUENCIES = ("daily", "weekly", "monthly", "rarely")
#: Targets that a table has at least.
LEAST = 20

TARGET = "url string, category string, priority string, frequency string"


def _rules() -> dict[str, Column]:
    """What is wrong with a row; ``turn`` numbers the rows of a url. A null is wrong wherever it stands."""
    among = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    return {
        "duplicate-url": F.col("turn") > 1,
        "not-https": ~F.coalesce(F.col("url").startswith("https://"), F.lit(False)),
        "unknown-category": among("category", CATEGORIES), "unknown-priority": among("priority", PRIORITIES), "unknown-frequency": among("frequency", FREQUENCIES),
    }


def write_targets(targets: DataFrame, path: str, least: int = LEAST) -> dict[str, int]:
    """Write (url, category, priority, frequency, violations) to ``path``; the number of violations of each constraint.

    The counts are metrics that Spark observes while the rows are written, so the table is read once.
    Of rows with equal urls all but the first in order of their columns are duplicates; ``too-few`` is 1
    where the table has less than ``least`` rows. Other columns are dropped.
    """
    place = Window.partitionBy("url").orderBy("category", "priority", "frequency")
    rows = targets.select("url", "category", "priority", "frequency").withColumn("turn", F.row_number().over(place))
    rules = _rules()
    told = F.filter(F.array(*[F.when(wrong, name) for name, wrong in rules.items()]), lambda v: v.isNotNull())
    rows = rows.withColumn("violations", told).drop("turn")
    seen = Observation("targets")
    numbers = [F.count_if(F.array_contains("violations", name)).alias(name) for name in rules]
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *numbers).write.parquet(path)
    metrics = seen.get
    return {"too-few": int(metrics["rows"] < least), **{name: metrics[name] for name in rules}}


def violations(spark: SparkSession, path: str) -> DataFrame:
    """(url, category, priority, frequency, violation): a row for each violation of a written table's rows."""
    rows = spark.read.schema(f"{TARGET}, violations array<string>").parquet(path)
    return rows.select("url", "category", "priority", "frequency", F.explode("violations").alias("violation"))


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The targets without any violation."""
    return spark.read.schema(f"{TARGET}, violations array<string>").parquet(path).where(F.size("violations") == 0).drop("violations")
