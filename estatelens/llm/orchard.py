"""Centroid clustering by Orchard search over exact integer vectors.

Each centroid keeps the other centroids sorted by their distance from it. A vector starts at some
centroid and walks along that centroid's list: whenever a centroid turns out closer, it jumps to the
closer one's list and starts there anew; centroids once visited are not measured again. Once the
next centroid of the list is strictly farther from the current one than twice the vector's distance,
the triangle inequality leaves no closer one, nor an equally close one, and the search ends.

Components are whole numbers and distances squared, so "farther than twice" is ``apart > 4 * best``
without any rounding. A round is one pass over the table in which every task adds up its own vectors;
the driver sees ``k`` centroids and nothing else. A lost executor costs the rerun of its tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this, after scaling, count as this: sums of any number of rows stay within 38 digits.
MOST = 1 << 62
#: What stands at places -1 and -2 of a sum: the distances and the number of vectors.
DISTANCE, COUNT = -1, -2


def usable(column: str, width: int) -> F.Column:
    """Exactly ``width`` components, none null or non-finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(column) == width) & finite, F.lit(False))


def whole_numbers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in 64-bit integers where squares of differences fit, else in Python's."""
    return fitting(np.clip(np.floor(rows.astype(np.float64) * scale), -float(MOST), float(MOST)).astype(np.int64))


def fitting(numbers: np.ndarray) -> np.ndarray:
    """64-bit integers if four times a squared distance fits them, else Python's integers."""
    most = isqrt((1 << 58) // max(1, numbers.shape[-1])) // 2
    if numbers.dtype != object and (not numbers.size or (numbers.max() <= most and numbers.min() >= -most)):
        return numbers
    return numbers.astype(object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=1)


class Neighbours:
    """The centroids, their distances from one another, and each one's list of the others."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.points = fitting(np.array(centroids, dtype=np.int64))
        k = len(centroids)
        self.apart = np.array([[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for b in centroids] for a in centroids], dtype=self.points.dtype)
        self.lists = np.array([[j for j in sorted(range(k), key=lambda j: (self.apart[i][j], j)) if j != i] for i in range(k)], dtype=np.int64).reshape(k, k - 1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, distances measured); ties go to the smaller number."""
        centroids, apart = self.points, self.apart
        if object in (points.dtype, centroids.dtype):
            points, centroids, apart = points.astype(object), centroids.astype(object), apart.astype(object)
        n, k = len(points), len(centroids)
        now, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = squared(points, centroids[now])
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        measured, going = n, np.arange(n) if k > 1 else np.empty(0, np.int64)
        while going.size:
            other = self.lists[now[going], at[going]]
            near = (apart[now[going], other] <= 4 * best[going]).astype(bool)
            going, other = going[near], other[near]
            at[going] += 1
            fresh = ~visited[going, other]
            asked, other = going[fresh], other[fresh]
            visited[asked, other] = True
            gap = squared(points[asked], centroids[other])
            measured += asked.size
            closer = ((gap < best[asked]) | ((gap == best[asked]) & (other < now[asked]))).astype(bool)
            moved = asked[closer]
            now[moved], best[moved], at[moved] = other[closer], gap[closer], 0
            going = going[at[going] < k - 1]
        return now, best, measured


def _points(batch: pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    return whole_numbers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)


def _sums(near: Neighbours, width: int, scale: int):
    """Adds up a task's vectors by centroid: rows of (cluster, place, total), at most ``k * (width + 2)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            points = _points(batch, width, scale)
            now, best, _ = near.nearest(points)
            for c in np.unique(now).tolist():
                own = now == c
                more = [int(own.sum()), int(best[own].astype(object).sum()), *(int(x) for x in points[own].sum(axis=0))]
                totals[c] = [a + b for a, b in zip(totals[c], more, strict=True)] if c in totals else more
        rows = [(c, place, Decimal(x)) for c, told in totals.items() for place, x in zip([COUNT, DISTANCE, *range(width)], told, strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.decimal128(38, 0))], ["cluster", "place", "total"])

    return run


def _totals(rows: DataFrame, near: Neighbours, width: int, scale: int) -> dict[tuple[int, int], int]:
    told = rows.select("embedding").mapInArrow(_sums(near, width, scale), "cluster int, place int, total decimal(38,0)")
    return {(r["cluster"], r["place"]): int(r["total"]) for r in told.groupBy("cluster", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}


def seeds(rows: DataFrame, k: int, prefix: str, scale: int) -> list[tuple[int, ...]]:
    """The vectors of the ``k`` smallest sha256 of prefix and id, in that order; rows of equal ids by their components."""
    first = rows.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256), "embedding").limit(k)
    return [tuple(int(x) for x in whole_numbers(np.array([r["embedding"]]), scale)[0]) for r in first.collect()]


def fit(rows: DataFrame, k: int, rounds: int, width: int, scale: int, prefix: str) -> list[tuple[int, ...]]:
    """The centroids after ``rounds`` rounds over the usable ``rows``; fewer than ``k`` if there are fewer vectors."""
    centroids = seeds(rows, k, prefix, scale)
    for _ in range(rounds if centroids else 0):
        totals = _totals(rows, Neighbours(centroids), width, scale)
        moved = [tuple(totals[c, i] // totals[c, COUNT] for i in range(width)) if (c, COUNT) in totals else own for c, own in enumerate(centroids)]
        if moved == centroids:
            break  # a fixed point: every further round gives the same
        centroids = moved
    return centroids


def _assigned(near: Neighbours, width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, best, _ = near.nearest(_points(batch, width, scale))
            gaps = [int(x) if x < 1 << 63 else None for x in best] if best.dtype == object else best
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(now.astype(np.int32)), pa.array(gaps, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, prefix: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors`` (vec_id, embedding, ...).

    Vectors of another width, null ones and those with null or non-finite components are left out.
    Repeated rows count as rows of their own; rows without a vec_id are clustered but start no
    cluster. With fewer than ``k`` vectors there are as many clusters as vectors. Components beyond
    2^62 after scaling count as 2^62; a distance or inertia that no 64-bit number holds is null.
    Other columns are dropped, so names cannot clash. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable("embedding", width))
    centroids = fit(rows, k, rounds, width, scale, prefix)
    kinds = "vec_id long, cluster int, distance long"
    if not centroids:
        nothing = rows.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    near = Neighbours(centroids)
    totals = _totals(rows, near, width, scale)
    held = lambda x: x if x < 1 << 63 else None
    each = [totals.get((c, DISTANCE), 0) for c in range(len(centroids))]
    told = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return rows.mapInArrow(_assigned(near, width, scale), kinds).select(
        "*",
        told([held(x) for x in each], "long").alias("cluster_inertia"),
        F.lit(held(sum(each))).cast("long").alias("inertia"),
        told([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], "string").alias("centroid_sha256"),
    )


def sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, prefix: str = "3:") -> str:
    """The same rows by plain comparison of every vector with every centroid."""
    gap = "list_sum(list_transform(range(1, {w} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".format(w=width)
    near = f"SELECT rid, vec_id, v, cl, d FROM (SELECT rid, vec_id, v, cl, CAST({gap} AS BIGINT) AS d, row_number() OVER (PARTITION BY rid ORDER BY {gap}, cl) AS rn FROM kept, {{c}}) WHERE rn = 1"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cl, v AS c FROM (SELECT sha256('{prefix}' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})",
            f"s{r} AS (SELECT cl, i, sum(x) AS s, count(*) AS n FROM (SELECT cl, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cl, i)",
            f"m{r} AS (SELECT cl, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cl)",
            f"c{r + 1} AS MATERIALIZED (SELECT o.cl, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cl))",
        ]
    parts.append(f"a AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(a.cl AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.cl) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c{rounds} USING (cl)"
    )
