"""The document index: changed pages, chunks, merges, expiry, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fingerprint, page_text, page_title, token_estimate, trimmed
from ..sources.tables import kept as kept_table
from .chunker import cut_documents


def page_table(snapshot: DataFrame) -> DataFrame:
    """(url, title, text, page_hash, crawled_at, and page_id if the snapshot has one) of the pages that were served."""
    served = snapshot.where(F.col("status").between(200, 299))
    own = [c for c in ("page_id",) if c in snapshot.columns]
    return served.select("url", page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("text"), "crawled_at", *own).withColumn("page_hash", fingerprint(F.col("text")))


def latest_per_url(pages: DataFrame) -> DataFrame:
    """The last row of each url; of rows crawled at the same time the first one (by page_id, if there is one, then by hash)."""
    ties = [c for c in ("page_id", "page_hash") if c in pages.columns]
    last = Window.partitionBy("url").orderBy(F.col("crawled_at").desc(), *ties)
    return pages.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def changed_pages(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh pages with what to do: process new and changed ones, skip the others."""
    old = stored.select("url", F.col("page_hash").alias("stored_hash"))
    same = F.col("page_hash").eqNullSafe(F.col("stored_hash"))
    return fresh.join(old, "url", "left").withColumn("action", F.when(same, "skip").otherwise("process"))


def _packed(section: Column, max_tokens: int, sep: str) -> Column:
    """Paragraphs of a section put together while they fit; a fence keeps a chunk open."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(False).alias("code"))

    def add(s: Column, para: Column) -> Column:
        code = s["code"] != para.contains("```")
        joined = F.when(s["cur"] != "", F.concat(s["cur"], F.lit(sep), para)).otherwise(para)
        fits = (token_estimate(joined) <= max_tokens) | code
        done = F.when(~fits & (s["cur"] != ""), F.array_append(s["done"], trimmed(s["cur"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(para).alias("cur"), code.alias("code"))

    close = lambda s: F.when(trimmed(s["cur"]) != "", F.array_append(s["done"], trimmed(s["cur"]))).otherwise(s["done"])
    return F.aggregate(F.split(section, r"\n\n+" if sep == "\n\n" else r"\n+", -1), start, add, close)


def chunk_documents(docs: DataFrame, max_tokens: int = 500, overlap: int = 50, sep: str = "\n\n") -> DataFrame:
    """(url, chunk_index, content) of (url, text, ...): sections at headings, large ones packed by paragraph.

    From the second on, a chunk starts with the end of the one before, as that was cut.
    """
    sections = F.filter(F.transform(F.split("text", r"(?=\n#{1,4}\s)", -1), trimmed), lambda s: s != "")
    pieces = F.flatten(F.transform(sections, lambda s: F.when(token_estimate(s) <= max_tokens, F.array(s)).otherwise(_packed(s, max_tokens, sep))))
    tail = lambda s: F.substring(s, F.greatest(F.lit(1), F.length(s) - 4 * overlap + 1), F.lit(4 * overlap))
    cut = docs.select("url", pieces.alias("p"))
    lapped = F.transform("p", lambda s, i: F.when(i == 0, s).otherwise(trimmed(F.concat(tail(F.get("p", i - 1)), F.lit("\n\n"), s))))
    return cut.select("url", F.posexplode(lapped).alias("chunk_index", "content"))


def chunk_table(docs: DataFrame, max_tokens: int = 500, overlap: int = 50, sep: str = "\n\n", cutter: Callable = chunk_documents) -> DataFrame:
    """Chunks with ids, hashes, token estimates and the number of chunks of their document.

    ``cutter`` is ``chunk_documents``, in columns, or ``chunker.cut_documents``, linear in the length of a text.
    """
    c = cutter(docs, max_tokens, overlap, sep)
    key = F.concat("url", F.lit("::"), F.col("chunk_index").cast("string"))
    return c.select(
        F.substring(F.sha2(key, 256), 1, 32).alias("chunk_id"), "url", "chunk_index", F.count(F.lit(1)).over(Window.partitionBy("url")).alias("total_chunks"),
        "content", fingerprint(F.col("content")).alias("content_hash"), token_estimate(F.col("content")).alias("tokens"), F.col("content").contains("```").alias("has_code"),
    )


def merge_chunks(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Keyed merge into a new version: new rows come in, known ones are renewed and keep created_at.

    A vector stays only while the chunk's hash does, so changed text is embedded again.
    """
    c, u = current.alias("c"), updates.alias("u")
    joined = c.join(u, F.col("c.chunk_id") == F.col("u.chunk_id"), "full_outer")
    fresh = F.col("u.chunk_id").isNotNull()
    pick = lambda n: F.when(fresh, F.col(f"u.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    kept = F.when(~fresh | F.col("c.content_hash").eqNullSafe(F.col("u.content_hash")), F.col("c.embedding"))
    return joined.select(
        F.coalesce("u.chunk_id", "c.chunk_id").alias("chunk_id"), *[pick(n) for n in ("url", "chunk_index", "content", "content_hash", "crawled_at")],
        F.coalesce("c.created_at", "u.crawled_at").alias("created_at"), F.when(fresh, F.coalesce("u.embedding", kept)).otherwise(F.col("c.embedding")).alias("embedding"),
    )


def stale(chunks: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    return chunks.where(F.col("crawled_at") < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))


def without_stale(chunks: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    return chunks.where(F.col("crawled_at") >= F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))


def orphans(chunks: DataFrame, updates: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Chunks of re-read documents that the new cut no longer has.

    ``read`` names the urls of the re-read documents; one that has become empty has no row in the
    cut, so without it such a document counts as not read.
    """
    touched = chunks.join((updates if read is None else read).select("url").distinct(), "url", "left_semi")
    return touched.join(updates.select("chunk_id"), "chunk_id", "left_anti")


def index_stats(chunks: DataFrame) -> DataFrame:
    """Per category and in all: chunks, chunks with a vector, oldest and newest crawl."""
    return chunks.rollup("category").agg(F.grouping("category").cast("int").alias("is_total"), F.count(F.lit(1)).alias("total"), F.count("embedding").alias("embedded"), F.min("crawled_at").alias("oldest"), F.max("crawled_at").alias("newest"))


def pending(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest chunks without a vector, first in first out."""
    return chunks.where("embedding IS NULL").orderBy("created_at", "chunk_id").limit(limit)


def embed(chunks: DataFrame, embed_fn: Callable, batch: str = "content") -> DataFrame:
    """Rows without a vector get one from ``embed_fn``, a vectorised function of the text."""
    vector = F.pandas_udf(embed_fn, "array<float>")
    todo = chunks.where("embedding IS NULL").withColumn("embedding", vector(F.col(batch)))
    return chunks.where("embedding IS NOT NULL").unionByName(todo)


def refresh(current: DataFrame, stored_pages: DataFrame, snapshot: DataFrame, as_of: str, embed_fn: Callable | None = None, max_tokens: int = 500, overlap: int = 50, read: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new version of the chunks, report): changed pages are cut and merged, orphans and stale rows go.

    A url stands for one page on both sides, the latest. Unchanged pages get the new crawl time, so what is live never expires. A page that has become
    empty loses its chunks. Pages with what to do and the cut are written once each, in the shared
    folder, for all that need them. ``read`` is the page table of the snapshot, where there is one already.
    """
    fresh = latest_per_url(page_table(snapshot) if read is None else read)
    marked = kept_table(changed_pages(fresh, latest_per_url(stored_pages)), "marked")  # a url stored twice would double its page
    process = marked.where("action = 'process'")
    cut = chunk_table(process, max_tokens, overlap, cutter=cut_documents).join(process.select("url", "crawled_at"), "url")
    cut = kept_table(cut, "cut").withColumn("embedding", F.lit(None).cast("array<float>"))
    gone = orphans(current, cut, process).select("chunk_id")
    seen = marked.where("action = 'skip'").select("url", F.col("crawled_at").alias("seen_at"))
    kept = current.join(gone, "chunk_id", "left_anti").join(seen, "url", "left").withColumn("crawled_at", F.coalesce("seen_at", "crawled_at")).drop("seen_at")
    merged = without_stale(merge_chunks(kept, cut), as_of)
    report = run_report(snapshot, marked, cut, merged, embed_fn is not None)
    return (embed(merged, embed_fn) if embed_fn else merged), report


def run_report(snapshot: DataFrame, marked: DataFrame, cut: DataFrame, merged: DataFrame, embeds: bool = True) -> DataFrame:
    """One row of true counts: pages attempted, succeeded, failed and skipped; chunks created, skipped (live ones of
    unchanged pages) and embedded (live ones that get a vector in this run)."""
    served = F.col("status").between(200, 299)
    pages = snapshot.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(served).alias("succeeded"), (F.count(F.lit(1)) - F.count_if(served)).alias("failed"))
    skipped = marked.agg(F.count_if(F.col("action") == "skip").alias("skipped"))
    live = merged.join(marked.where("action = 'skip'").select("url", F.lit(True).alias("same")), "url", "left")
    told = live.agg(F.count_if(F.coalesce("same", F.lit(False))).alias("chunks_skipped"), F.count_if(F.col("embedding").isNull() & F.lit(embeds)).alias("chunks_embedded"))
    return pages.join(skipped).join(cut.agg(F.count(F.lit(1)).alias("chunks_created"))).join(told)  # four one-row sides
