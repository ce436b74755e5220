"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Every unit vector u is kept as s*q + e with int8 codes q, its own scale s and a bound
eps >= |e|. For two vectors the cosine differs from s_u*s_v*(q_u . q_v) by at most
eps_u*(1 + eps_v) + eps_v, so a pair whose coded product plus that bound stays below the
threshold cannot link. All other pairs are recomputed in double precision.

Equal vectors are first folded into one class with a count. Classes are dealt to groups by
hash; a cell of two groups is one task's work, cut into blocks that stay in cache. A cell
returns sums of link counts and a spanning forest of its links, never the links themselves.
The work is quadratic in the number of distinct vectors, as tile products are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components, spanning_edges

BLOCK = 1024
#: Pairs of a tile that are recomputed at a time.
PAIRS_AT_ONCE = 1 << 16
#: Bytes of the vectors, as doubles, of a group; a task holds two groups.
GROUP_BYTES = 8 << 20


def usable(column: str) -> F.Column:
    """Not null, not empty, only finite components, not the zero vector."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes (whole numbers from -127 to 127), scales, bounds on what coding lost."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, lost * (1 + 1e-9) + 1e-12


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def links_of_blocks(x: tuple, y: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in x, j in y) whose cosine reaches the threshold. x, y: unit, codes, scale, lost."""
    # a tile's codes are widened for the library's matrix product, to a kind in which its sums stay exact
    wide = np.float32 if x[1].shape[1] * 127 * 127 <= 2**24 else np.float64
    product = x[1].astype(wide) @ y[1].astype(wide).T
    slack = x[3].max() * (1 + y[3].max()) + y[3].max() + 1e-9
    least = (threshold - slack) / (x[2].max() * y[2].max()) if threshold > slack else -np.inf
    maybe = product >= least
    if not maybe.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.nonzero(maybe)
    bound = x[3][i] * (1 + y[3][j]) + y[3][j] + 1e-9
    close = product[i, j] * x[2][i] * y[2][j] + bound >= threshold
    i, j = i[close], j[close]
    # one exact comparison for every pair, however many a tile has
    slices = range(0, i.size, PAIRS_AT_ONCE)
    same = [np.einsum("nd,nd->n", x[0][i[k : k + PAIRS_AT_ONCE]], y[0][j[k : k + PAIRS_AT_ONCE]]) >= threshold for k in slices]
    same = np.concatenate([np.empty(0, bool), *same])
    return i[same], j[same]


def cell_links(ids: np.ndarray, copies: np.ndarray, rows: np.ndarray, group: np.ndarray, threshold: float):
    """Link counts per vector and a spanning forest for one cell; across its groups if it has two."""
    unit = unit_rows(rows)
    codes, scale, lost = quantised(unit)
    order = np.lexsort((scale, group))  # blocks of like scale have tight bounds
    unit, codes, scale, lost, ids, copies, group = (v[order] for v in (unit, codes, scale, lost, ids, copies, group))
    border = int(np.searchsorted(group, group[0], side="right"))
    cross = border < ids.size
    counts, labels = np.zeros(ids.size), np.arange(ids.size)
    found: list[np.ndarray] = []
    cut = lambda lo, hi: [slice(k, min(k + BLOCK, hi)) for k in range(lo, hi, BLOCK)]
    left = cut(0, border)
    right = cut(border, ids.size) if cross else left
    parts = (unit, codes, scale, lost)
    for a in left:
        for b in right:
            if not cross and b.start < a.start:
                continue
            i, j = links_of_blocks(tuple(v[a] for v in parts), tuple(v[b] for v in parts), threshold)
            i, j = i + a.start, j + b.start
            if a == b:
                i, j = i[i < j], j[i < j]
            if i.size:
                counts += np.bincount(i, copies[j], ids.size) + np.bincount(j, copies[i], ids.size)
                kept = spanning_edges(i, j, labels)
                found.append(np.stack([ids[i[kept]], ids[j[kept]]]))
    edges = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    linked = counts > 0
    return ids[linked], counts[linked].astype(np.int64), edges


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Add n_links, component_id and kept to each row of ``vectors`` (vec_id, embedding, ...).

    Two rows link when the cosine of their embeddings, in double precision, is at least
    ``threshold``. Null, empty, zero and non-finite vectors and rows without a vec_id link with
    nothing and keep their own id as component; vectors of different width never link. Repeated
    rows count as rows of their own. Columns of ``vectors`` other than the two are dropped, so
    names cannot clash. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = usable("embedding") & F.col("vec_id").isNotNull()
    classes = rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "vectors")
    widths = classes.groupBy(F.size("embedding").alias("width")).count().collect()  # a row per width of vector
    parts = []
    for width, n in widths:
        groups = max(4, -(-n * width * 8 // group_bytes))
        own = F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int")
        dealt = classes.where(F.size("embedding") == width).withColumn("grp", own)
        other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
        dealt = dealt.select("rep", "copies", "embedding", "grp", other)
        dealt = dealt.select("rep", "copies", "embedding", "grp", F.least("grp", "other").alias("x"), F.greatest("grp", "other").alias("y"))
        parts.append(dealt.groupBy("x", "y").applyInArrow(_cell(int(width), threshold), "node long, peer long, links long"))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = materialize(found, "links")
    links = found.where("peer IS NULL").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("near"))
    named = connected_components(found.where("peer IS NOT NULL"), "node", "peer").withColumnRenamed("node", "rep")
    told = (
        classes.join(links, "rep", "left").join(named, "rep", "left")
        .select("embedding", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    asked = rows.withColumn("embedding", F.when(good, F.col("embedding")))
    return asked.join(told, "embedding", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )


def _cell(width: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        rows = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        group = get("grp")
        x, y = int(table.column("x")[0].as_py()), int(table.column("y")[0].as_py())
        empty = np.empty(0, np.int64)
        if x != y and np.unique(group).size < 2:
            nodes, counts, edges = empty, empty, np.empty((2, 0), np.int64)
        else:
            nodes, counts, edges = cell_links(get("rep"), get("copies").astype(np.float64), rows, group, threshold)
        peers = pa.concat_arrays([pa.nulls(nodes.size, pa.int64()), pa.array(edges[1], pa.int64())])
        return pa.table({
            "node": pa.array(np.concatenate([nodes, edges[0]]), pa.int64()),
            "peer": peers,
            "links": pa.array(np.concatenate([counts, np.zeros(edges.shape[1], np.int64)]), pa.int64()),
        })

    return run
