"""Streams give what the batch jobs give."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from estatelens.operators import mappings, readiness, runs, telemetry
from estatelens.sources.estate import table
from estatelens.streaming import streams


def landed(df, path, parts=3):
    df.repartition(parts).write.parquet(str(path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


EVENT = "ts timestamp, session_id string, kind string, server_id string, op string, cloud_id string, notes string, seq long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set(streams.STORE, ROCKS)
    yield
    spark.conf.unset(streams.STORE)


def feed(spark, folder, rows):
    """One file is one batch."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder))


def run_sessions(spark, folder, tmp_path, name="sessions"):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = streams.session_state(stream, "1 minute")
    out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / name / f"b={n}"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_session_state_equals_batch(spark, sf, tmp_path, rocks):
    events = table(spark, sf, "mapping_events").where("seq < 400").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = events.select(*[c.split()[0] for c in EVENT.split(", ")]).collect()
    for k in range(3):  # shuffled over batches
        feed(spark, tmp_path / "in", [tuple(r) for r in rows if (r.seq * 7919) % 3 == k])
    out = run_sessions(spark, tmp_path / "in", tmp_path)
    got = out.where("status <> 'expired'").groupBy("session_id", "kind", "server_id").agg(F.max_by(F.struct("status", "cloud_id", "notes"), F.struct("b")).alias("v"))
    want = mappings.mapping_state(events)
    told = lambda df: {(r.session_id, r.kind, r.server_id): tuple(r.v) for r in df.collect()}
    assert told(got) == told(want.select("session_id", "kind", "server_id", F.struct("status", "cloud_id", "notes").alias("v")))


def test_a_session_dies_a_day_after_its_last_event_or_import(spark, tmp_path, rocks):
    place = tmp_path / "in"
    feed(spark, place, [(at(0), "a", "user", "bob", "map", "c1", None, 5), (at(0), "b", "user", "eve", "map", "c2", None, 1)])
    feed(spark, place, [(at(1), "a", "user", "bob", "skip", None, None, 3)])  # late by seq: undoes nothing, keeps the session
    feed(spark, place, [(at(20), "b", None, None, "import", None, None, None)])
    first = run_sessions(spark, place, tmp_path, "one")
    assert [(r.status, r.cloud_id, r.seq) for r in first.where("session_id = 'a'").orderBy("b").collect()] == [("mapped", "c1", 5)] * 2
    # the stream starts again from its checkpoint
    feed(spark, place, [(at(26), "z", "user", "x", "skip", None, None, 1)])  # 25 hours after a's last event
    feed(spark, place, [(at(27), "b", "user", "eve", "skip", None, "why", 2)])
    feed(spark, place, [(at(60), "z", "user", "x", "map", "c9", None, 2)])
    feed(spark, place, [(at(61), "a", "user", "bob", "skip", None, None, 4)])  # a new session: the old seq 5 is forgotten
    rows = run_sessions(spark, place, tmp_path, "two").collect()
    ended = {(r.session_id, r.expires_ms // 3_600_000 - 473_352) for r in rows if r.status == "expired"}
    assert ended == {("a", 25), ("b", 51), ("z", 50)}
    assert [(r.status, r.cloud_id, r.notes) for r in rows if r.session_id == "b" and r.status != "expired"] == [("skipped", "c2", "why")]
    assert [(r.status, r.cloud_id, r.seq) for r in rows if r.session_id == "a" and r.status != "expired"] == [("skipped", None, 4)]


def test_job_status_equals_batch(spark, sf, tmp_path):
    events = table(spark, sf, "job_events")
    streams.job_status(landed(events, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = max(tmp_path.joinpath("out").glob("v*"), key=lambda p: int(p.name[1:]))
    assert sorted(map(str, spark.read.parquet(str(last)).collect())) == sorted(map(str, telemetry.latest_status(events).collect()))


def test_readiness_stream_equals_batch(spark, sf, tmp_path):
    scripts = table(spark, sf, "scripts").where("script_id < 200")
    streams.stream_readiness(landed(scripts, tmp_path / "in", 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, readiness.verdicts(scripts).collect()))


def test_stage_windows(spark, sf, tmp_path):
    events = table(spark, sf, "job_events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.stage_windows(landed(events, tmp_path / "in", 1), late="60 days")
    out.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("windows").count() == streams.stage_windows(events).count()


def test_incremental_refresh_embeds_what_changed_and_logs_once(spark, sf, tmp_path):
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t))])

    pages = table(spark, sf, "snapshot_1").drop("page_id").limit(20)
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    args = (str(tmp_path / "chunks"), str(tmp_path / "known"), "2024-01-02 00:00:00", str(tmp_path / "cp2"), embed, str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages"))
    streams.incremental_refresh(stream(), *args).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "chunks" / "v0"))
    assert first.select("url").distinct().count() == 20 and first.where("embedding IS NULL").isEmpty()
    one = pages.orderBy("url").limit(2).select("url", F.concat("html", F.lit("<p>more</p>")).alias("html"), F.lit(200).alias("status"), (F.col("crawled_at") + F.expr("INTERVAL 1 DAY")).alias("crawled_at"))
    one.unionByName(one.limit(1).withColumns({"status": F.lit(500), "url": F.lit("gone")})).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    streams.incremental_refresh(stream(), *args).awaitTermination()
    log = {r.batch_id: r for r in runs.crawl_runs(spark, str(tmp_path / "log")).collect()}
    assert set(log) == {0, 1} and (log[0].attempted, log[0].chunks_embedded) == (20, first.count())
    assert (log[1].attempted, log[1].succeeded, log[1].failed, log[1].n_errors) == (3, 2, 1, 1) and 0 < log[1].chunks_embedded <= log[1].chunks_created < first.count()
    # the last batch is replayed
    again = runs.write_crawl_run(str(tmp_path / "log"), "refresh", 1, spark.createDataFrame([(9,) * 7], runs.REPORT), spark.createDataFrame([], runs.ERRORS))
    assert not again and runs.crawl_runs(spark, str(tmp_path / "log")).count() == 2
