"""Telemetry of migration jobs: cost, stage timings, latest status, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import rulepacks as packs


def cost_rollup(usage: DataFrame) -> DataFrame:
    """Per job of (job_id, model, tier, tokens): cost to four places, models, tokens. Unknown models cost their tier's rate."""
    rate = F
    for model, price in packs.MODEL_PRICES.items():
        rate = rate.when(F.col("model") == model, price)
    rate = rate.otherwise(F.when(F.col("tier") == "cheap", packs.CHEAP_PRICE).otherwise(packs.EXPENSIVE_PRICE))
    cost = F.sum(F.col("tokens") * rate) / 1_000_000
    return usage.groupBy("job_id").agg((F.floor(cost * 10000 + 0.5) / 10000).alias("cost"), F.count_distinct("model").alias("n_models"), F.sum("tokens").alias("tokens"))


def stage_timings(events: DataFrame) -> DataFrame:
    """Per stage: number, mean and 95th percentile of milliseconds (a value that occurs, off by 1e-5 of the ranks at most, in bounded memory)."""
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.percentile_approx("ms", 0.95, 100_000), 6).alias("p95_ms"))


#: Size of a sketch: the rank of a quantile is off by about 1.33 % at 200, by less than 0.35 % at 800.
SKETCH = 800


def stage_sketches(events: DataFrame) -> DataFrame:
    """(stage, hour, n, sketch): a mergeable quantile sketch of the milliseconds of each stage and hour, to be stored."""
    timed = events.where("ms IS NOT NULL")
    return timed.groupBy("stage", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("ms").cast("double"), SKETCH).alias("sketch"))


def window_quantiles(sketches: DataFrame, since: str, until: str, quantile: float = 0.95) -> DataFrame:
    """(stage, n, quantile_ms) over the hours from ``since`` to before ``until``, from stored sketches alone."""
    own = sketches.where((F.col("hour") >= F.to_timestamp(F.lit(since))) & (F.col("hour") < F.to_timestamp(F.lit(until))))
    merged = own.groupBy("stage").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH).alias("sketch"))
    return merged.select("stage", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(quantile)).alias("quantile_ms"))


def timings_of_maps(jobs: DataFrame) -> DataFrame:
    """(job_id, stage, ms) of a map column ``timings``."""
    return jobs.select("job_id", F.explode("timings").alias("stage", "ms"))


def latest_status(events: DataFrame) -> DataFrame:
    """Per job the latest event's stage with its progress; nothing follows a terminal stage earlier in time."""
    last = Window.partitionBy("job_id").orderBy(F.col("ts").desc(), F.col("seq").desc())
    progress = F.create_map(*[F.lit(x) for kv in packs.JOB_PROGRESS.items() for x in kv])[F.col("stage")]
    rows = events.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    return rows.select("job_id", "seq", "ts", "stage", progress.alias("progress"), F.col("stage").isin("completed", "failed").alias("is_terminal"))


def retained(status: DataFrame, as_of: str) -> DataFrame:
    """Completed jobs stay an hour, failed ones a day, others as long as they run."""
    now = F.to_timestamp(F.lit(as_of))
    return status.where(F.when(F.col("stage") == "completed", F.col("ts") >= now - F.expr("INTERVAL 1 HOUR")).when(F.col("stage") == "failed", F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")).otherwise(True))
