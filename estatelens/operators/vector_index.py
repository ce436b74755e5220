"""A stored inverted-file index with product quantisation.

Vectors, as unit vectors, are dealt to the cells of a coarse k-means. What is left of a vector
after its cell's centre is cut into ``parts`` pieces, and each piece is named by the nearest of up
to 256 words of that piece's codebook: a vector becomes ``parts`` bytes. A query works out, for
each piece, its product with every word once; a document's similarity is then estimated by adding
up table entries, without its vector.

The index is two tables under one folder: ``codes`` and ``vectors``, both partitioned by cell, so
a search reads the directories of the probed cells only, and of ``vectors`` the rows of the
candidates' cells. Centres and codebooks are small and lie beside them. A hot cell is written by as
many tasks as its rows ask for. Cells and words are fitted on a bounded sample, all rows are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows on which cells and codebooks are fitted, about, at most.
FIT_ROWS = 50_000
#: Rows of a cell that one task writes or searches, about.
SLICE_ROWS = 1 << 17
#: Queries that one task asks of a slice of a cell, about.
QUERY_ROWS = 4096
#: Rows that a k-means compares with its centres at a time.
STEP = 4096
#: Rounds of a k-means.
ROUNDS = 12


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def k_means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of a bounded sample; fewer than ``k`` if it has fewer different rows. Empty ones take far rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        own, far = np.empty(len(rows), np.int64), np.empty(len(rows))
        for at in range(0, len(rows), STEP):  # the table of all gaps would be far larger than the sample
            part = rows[at : at + STEP]
            gap = (part * part).sum(1)[:, None] - 2 * part @ centres.T + (centres * centres).sum(1)[None, :]
            own[at : at + STEP], far[at : at + STEP] = gap.argmin(1), gap.min(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = rows[np.argsort(-far)[: empty.size]]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * rows @ centres.T).argmin(1)


def _rows(batch: pa.RecordBatch | pa.Table, column: str, width: int) -> np.ndarray:
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _usable(docs: DataFrame, name: str, width: int) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return docs.where((F.size("vector") == width) & finite).select(F.col(name).cast("long").alias(name), F.col("vector").cast("array<double>").alias("vector"))


@dataclass
class VectorIndex:
    """An index as it lies in its folder; ``probed`` is what the last search read of it."""

    spark: SparkSession
    path: str
    width: int
    centres: np.ndarray
    words: list[np.ndarray]
    counts: dict[int, int]
    probed: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def build(docs: DataFrame, path: str, cells: int = 16, parts: int = 16, words: int = 256) -> VectorIndex:
        """Index (doc_id, vector, ...) under ``path``, which must not exist. The most frequent width is indexed.

        Null vectors, and those with null or non-finite components, are not found by any search;
        other columns are dropped. An empty table gives an index in which nothing is found.
        """
        spark = docs.sparkSession
        widths = docs.where(F.size("vector") > 0).groupBy(F.size("vector").alias("w")).count().orderBy(F.col("count").desc(), "w").first()
        width = widths["w"] if widths else 1
        rows = _usable(docs, "doc_id", width)
        share = min(1.0, FIT_ROWS / max(1, rows.count()))
        drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
        fitted = drawn.select(F.lit(0).alias("one"), "vector").groupBy("one").applyInArrow(_fit_cells(width, cells), "place int, point array<double>")
        centres = np.array([r["point"] for r in fitted.orderBy("place").collect()]).reshape(-1, width)
        books: list[np.ndarray] = []
        if len(centres):
            pieces = drawn.select(F.explode(F.sequence(F.lit(0), F.lit(min(parts, width) - 1))).alias("piece"), "vector").groupBy("piece").applyInArrow(_fit_words(centres, width, min(parts, width), words), "piece int, place int, point array<double>")
            told: dict[int, list] = {}
            for r in pieces.orderBy("piece", "place").collect():  # parts * words points of width / parts
                told.setdefault(r["piece"], []).append(r["point"])
            books = [np.array(told[p]) for p in sorted(told)]
        coded = rows.mapInArrow(_coded(centres, books, width), "doc_id long, vector array<float>, cell int, code binary")
        sized = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}
        slices = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, n in sized.items() for x in (c, -(-n // SLICE_ROWS))]), F.col("cell")), F.lit(1)) if sized else F.lit(1)
        dealt = coded.withColumn("slice", F.pmod(F.xxhash64("doc_id"), slices).cast("int")).repartition("cell", "slice")
        dealt.select("doc_id", "slice", "code", "cell").write.partitionBy("cell").parquet(f"{path}/codes")
        dealt.select("doc_id", "vector", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        shape = [(-1, c, x.tolist()) for c, x in enumerate(centres)] + [(p, k, x.tolist()) for p, book in enumerate(books) for k, x in enumerate(book)]
        spark.createDataFrame([(-2, width, [])] + [(-3, c, [float(n)]) for c, n in sized.items()] + shape, "piece int, place int, point array<double>").coalesce(1).write.parquet(f"{path}/shape")
        return VectorIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        """The index that an earlier job built."""
        told: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/shape").orderBy("piece", "place").collect():
            told.setdefault(r["piece"], []).append((r["place"], r["point"]))
        width = told[-2][0][0]
        centres = np.array([p for _, p in told.get(-1, [])]).reshape(-1, width)
        books = [np.array([p for _, p in told[k]]) for k in sorted(told) if k >= 0]
        return VectorIndex(spark, path, width, centres, books, {c: int(n[0]) for c, n in told.get(-3, [])})

    def candidates(self, queries: DataFrame, probes: int, most: int) -> DataFrame:
        """(query_id, doc_id, cell, estimate): for each query and slice of a probed cell the ``most`` of the highest estimates.

        A task holds one slice and one block of queries; vectors of queries do not travel with what is found.
        """
        kinds = "query_id long, query array<double>, cell int"
        asked = _usable(queries, "query_id", self.width).mapInArrow(_probing(self.centres, self.width, probes), kinds)
        meets = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # at most as many as there are cells
        cells = sorted(meets)
        self.probed = {"cells": len(cells), "of_cells": len(self.counts), "rows": sum(self.counts.get(c, 0) for c in cells), "of_rows": sum(self.counts.values())}
        codes = self.spark.read.schema("doc_id long, slice int, code binary, cell int").parquet(f"{self.path}/codes").where(F.col("cell").isin(cells))
        slices = max([1, *(-(-self.counts.get(c, 0) // SLICE_ROWS) for c in cells)])
        blocks = max([1, *(-(-n // QUERY_ROWS) for n in meets.values())])
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
        asked = asked.withColumn("slice", each(slices)).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        codes = codes.withColumn("block", each(blocks))
        keys = ["cell", "slice", "block"]
        return asked.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInArrow(_estimated(self.centres, self.words, self.width, most), "query_id long, doc_id long, cell int, estimate double")

    def with_vectors(self, near: DataFrame) -> DataFrame:
        """``near`` with the stored vectors; only the directories of cells with candidates are read."""
        vectors = self.spark.read.schema("doc_id long, vector array<float>, cell int").parquet(f"{self.path}/vectors")
        return near.join(vectors, ["cell", "doc_id"])


def _fit_cells(width: int, cells: int):
    def run(table: pa.Table) -> pa.Table:
        centres = k_means(unit(_rows(table, "vector", width)), cells, 1)
        return pa.table({"place": pa.array(np.arange(len(centres), dtype=np.int32)), "point": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    return run


def _fit_words(centres: np.ndarray, width: int, parts: int, words: int):
    """One piece's codebook from what is left of the sample after the cells' centres."""

    def run(table: pa.Table) -> pa.Table:
        piece = table.column("piece")[0].as_py()
        rows = unit(_rows(table, "vector", width))
        left = (rows - centres[nearest(rows, centres)])[:, np.array_split(np.arange(width), parts)[piece]]
        book = k_means(left, words, 2 + piece)
        return pa.table({"piece": pa.array([piece] * len(book), pa.int32()), "place": pa.array(np.arange(len(book), dtype=np.int32)), "point": pa.array(book.tolist(), pa.list_(pa.float64()))})

    return run


def _coded(centres: np.ndarray, books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(_rows(batch, "vector", width))
            if not len(rows):
                continue
            cell = nearest(rows, centres)
            left = rows - centres[cell]
            codes = np.stack([nearest(left[:, at], book) for at, book in zip(np.array_split(np.arange(width), len(books)), books, strict=True)], axis=1).astype(np.uint8)
            told = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("vector").cast(pa.list_(pa.float32())), pa.array(cell.astype(np.int32)), told], ["doc_id", "vector", "cell", "code"])

    return run


def _probing(centres: np.ndarray, width: int, probes: int):
    """Each query with its nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(_rows(batch, "vector", width))
            most = min(probes, len(centres))
            gap = (centres * centres).sum(1)[None, :] - 2 * rows @ centres.T
            cells = np.argsort(gap, axis=1, kind="stable")[:, :most].astype(np.int32).ravel()
            at = pa.array(np.repeat(np.arange(len(rows)), most))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("vector").take(at), pa.array(cells, pa.int32())], ["query_id", "query", "cell"])

    return run


def _estimated(centres: np.ndarray, books: list[np.ndarray], width: int, most: int):
    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked.num_rows and given.num_rows:
            cell = asked.column("cell")[0].as_py()
            queries = unit(_rows(asked, "query", width))
            codes = np.frombuffer(b"".join(given.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
            docs = given.column("doc_id").to_numpy()
            base = queries @ centres[cell]
            splits = np.array_split(np.arange(width), len(books))
            for k, query in enumerate(queries):
                estimate = np.full(len(docs), base[k])
                for j, (at, book) in enumerate(zip(splits, books, strict=True)):
                    estimate += (book @ query[at])[codes[:, j]]
                least = np.partition(estimate, len(docs) - most)[len(docs) - most] if len(docs) > most else -np.inf
                high = np.flatnonzero(estimate >= least)
                best = high[np.lexsort((docs[high], -estimate[high]))[:most]]  # copies in order of id
                for column, values in zip(out, (np.full(best.size, k), docs[best], estimate[best]), strict=True):
                    column.append(values)
        row, doc, value = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
        at = pa.array(row.astype(np.int64))
        return pa.table({"query_id": asked.column("query_id").take(at), "doc_id": pa.array(doc.astype(np.int64)), "cell": asked.column("cell").take(at), "estimate": pa.array(value.astype(np.float64))})

    return run
