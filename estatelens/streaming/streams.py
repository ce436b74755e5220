"""Streaming forms of the jobs: scripts on arrival, session state, job status, refresh, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import index, readiness, runs
from ..sources.io import split_rejects, split_snapshots

OUT = "session_id string, kind string, server_id string, status string, cloud_id string, notes string, seq long, expires_ms long"
TTL_MS = 24 * 3600 * 1000
STORE = "spark.sql.streaming.stateStore.providerClass"


def stream_readiness(uploads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each arriving script gets its verdict; batches are appended under ``path``."""

    def analyse(batch: DataFrame, batch_id: int) -> None:
        good, _ = split_rejects(batch)
        readiness.verdicts(good).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a replayed batch writes its own folder again

    return uploads.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Sessions(StatefulProcessor):
    """The mappings of each session, until a day after its last event.

    A session has one timer, which its events and imports move on; an event that comes later than
    a day after the last one finds a session that is over, whether the timer has told so or not. An event changes a mapping only
    if none of a higher ``seq`` has done so before; the time that it carries still keeps the session alive.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entry = "status string, cloud_id string, notes string, seq long, map_seq long, note_seq long"
        self.mappings = handle.getMapState("mappings", "kind string, server_id string", entry)
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        touched: dict[tuple, list] = {}
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "seq"])
            for ts, op, kind, server_id, cloud_id, notes, seq in zip(*(pdf[c] for c in ("ts", "op", "kind", "server_id", "cloud_id", "notes", "seq")), strict=True):
                now = int(ts.timestamp() * 1000)
                if last is not None and now > last + TTL_MS:  # it was over before this event, only no timer had told so yet
                    yield self._rows(key, [(*place, *entry[:4]) for place, entry in touched.items()], last + TTL_MS)
                    yield self._over(key, last)
                    touched.clear()
                    last = now
                last = now if last is None else max(last, now)
                if op == "import":  # renews the session and maps nothing
                    continue
                place = (kind, server_id)
                if place not in touched:
                    touched[place] = list(self.mappings.getValue(place)) if self.mappings.containsKey(place) else [None, None, None, -1, -1, -1]
                entry = touched[place]
                if seq > entry[3]:
                    entry[3], entry[0] = int(seq), "mapped" if op == "map" else "skipped"
                if op == "map" and seq > entry[4]:
                    entry[4], entry[1] = int(seq), cloud_id
                if isinstance(notes, str) and seq > entry[5]:
                    entry[5], entry[2] = int(seq), notes
        for place, entry in touched.items():
            self.mappings.updateValue(place, tuple(entry))
        self.last.update((last,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(last + TTL_MS)
        yield self._rows(key, [(*place, *entry[:4]) for place, entry in touched.items()], last + TTL_MS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._over(key, self.last.get()[0])

    def _over(self, key: tuple, last: int) -> pd.DataFrame:
        self.mappings.clear()
        self.last.clear()
        return self._rows(key, [(None, None, "expired", None, None, None)], last + TTL_MS)

    def _rows(self, key: tuple, rows: list[tuple], expires: int) -> pd.DataFrame:
        told = [(key[0], *row, expires) for row in rows]
        return pd.DataFrame(told, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def session_state(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Updates of each session's mappings, and a row with status ``expired`` when a session is over.

    ``events`` are (ts, session_id, kind, server_id, op, cloud_id, notes, seq); op is map, skip or
    import. A session ends 24 hours of event time after its last event; what comes later starts it
    anew. State lives in the RocksDB store, which the session must name (``STORE``).
    """
    keyed = events.withWatermark("ts", late).groupBy("session_id")
    return keyed.transformWithStateInPandas(Sessions(), OUT, "update", "EventTime")


def stage_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and mean latency by stage."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"))


def job_status(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest status per job, merged batch by batch into versions under ``path``."""
    from ..operators.telemetry import latest_status

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("job_id", "seq", "ts", "stage")
        if batch_id:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{batch_id - 1}").select("job_id", "seq", "ts", "stage"))
        latest_status(rows).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_refresh(snapshots: DataFrame, chunks_path: str, pages_path: str, as_of: str, checkpoint: str, embed_fn: Callable | None = None, log_path: str | None = None, run_id: str = "refresh") -> StreamingQuery:
    """Every landed snapshot refreshes the index; versions of chunks and pages are kept side by side.

    Only changed pages are cut and embedded anew. A replayed batch writes its own versions again and
    has its row in the run log once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pages = index.latest_per_url(index.page_table(batch))
        if batch_id:
            current, stored = spark.read.parquet(f"{chunks_path}/v{batch_id - 1}"), spark.read.parquet(f"{pages_path}/v{batch_id - 1}")
        else:
            stored = pages.limit(0)
            current = spark.createDataFrame([], "chunk_id string, url string, chunk_index int, content string, content_hash string, crawled_at timestamp, created_at timestamp, embedding array<float>")
        merged, report = index.refresh(current, stored, batch, as_of, embed_fn)
        merged.write.mode("overwrite").parquet(f"{chunks_path}/v{batch_id}")
        kept = stored.join(pages.select("url"), "url", "left_anti").unionByName(pages, allowMissingColumns=True)
        kept.write.mode("overwrite").parquet(f"{pages_path}/v{batch_id}")
        if log_path:
            runs.write_crawl_run(log_path, run_id, batch_id, report, split_snapshots(batch)[1])

    return snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
