"""Retrieval: exact, partitioned and keyword top-k, merged rankings, query texts, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import kept as kept_table
from .vector_index import VectorIndex

#: Bytes of vectors that a task holds of each side, about.
GROUP_BYTES = 32 << 20
#: Cells that documents are dealt to, at most; each has one of their own vectors as pivot.
MOST_CELLS = 64
#: Widths of vectors that have pivots; those of rarer widths form a cell each.
MOST_WIDTHS = 16
#: Similarities that a task works out at a time.
PAIRS_AT_ONCE = 1 << 20
#: Rows of matched words, and of queries' words, that are sent to all tasks; more are joined by shuffles.
SMALL = 50_000
#: By so much a rounded similarity or an angle may be off, at most.
SLACK = 2e-6


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_topk(queries: DataFrame, docs: DataFrame, k: int = 4, threshold: float = 0.7, by_category: bool = False, group_bytes: int = GROUP_BYTES, visited: list[DataFrame] | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, rank) of (query_id, vector) against (doc_id, vector, category): exact.

    Documents go to the cell of the pivot with which they form the smallest angle; a pivot is a
    document's own vector. No document of a cell is nearer to a query than the query's angle to
    the pivot less the cell's largest angle. Round one compares each query with the cell of the
    highest such bound only, which gives a lower bound of its k-th similarity; round two visits the
    cells whose bound reaches it, and skips the others. Documents that fit one group form one cell.

    Queries meet documents of their width (and category, if that is not null) only; vectors that are null, empty or hold
    null or non-finite components are left out, a zero vector has the similarity 0 to all. Equal
    similarities, rounded to six places, are ranked by doc_id. A cell larger than ``group_bytes`` is cut
    into slices by hash, and so many queries. ``visited`` receives (query_id, cell) of both rounds.
    """
    spark = docs.sparkSession
    kept = ["category"] if by_category else []
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = lambda d, name: d.where((F.size("vector") > 0) & finite).select(F.col(name).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("width"), *kept)
    asked, given = vectors(queries, "query_id"), vectors(docs, "doc_id")
    if by_category:
        asked, given = asked.where("category IS NOT NULL"), given.where("category IS NOT NULL")
    sizes = {r["width"]: r["n"] for r in given.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "width").limit(MOST_WIDTHS).collect()}
    bytes_ = sum(w * 8 * n for w, n in sizes.items())
    cells = min(MOST_CELLS, -(-bytes_ // group_bytes))
    groups = max(1, -(-bytes_ // (group_bytes * max(1, cells))))
    blocks = max(1, -(-asked.count() * 8 * max(sizes, default=1) // group_bytes)) if cells > 1 else 1
    slice_of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
    keys = ["width", *kept, "cell", "part", "block"]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        """The best of each pair of groups; what is shuffled besides the vectors is k rows a query and group."""
        left = left.withColumn("part", every(groups)).withColumn("block", slice_of(blocks))
        right = right.withColumn("part", slice_of(groups)).withColumn("block", every(blocks))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_partial(k, threshold), "query_id long, doc_id long, similarity double")

    if cells <= 1:
        if visited is not None:
            visited.append(asked.select(F.col("id").alias("query_id"), F.lit(0).alias("cell")))
        return _best(meet(asked.withColumn("cell", F.lit(0)), given.withColumn("cell", F.lit(0))), k)
    pivots = _pivots(given.where(F.col("width").isin(*sizes)), cells)
    own = [f"{c} {t}" for c, t in given.dtypes]
    placed = kept_table(given.mapInArrow(_placed(pivots), ", ".join([*own, "cell int", "angle double"])), "cells")
    spread = {(r["width"], r["cell"]): (r["n"], r["angle"]) for r in placed.where(F.col("width").isin(*sizes)).groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect()}
    placed = placed.drop("angle")
    told = ", ".join([*own, "cell int"])
    opening = kept_table(asked.withColumn("least", F.lit(None).cast("double")).mapInArrow(_visits(pivots, spread, True, threshold), told), "opening")
    first = kept_table(_best(meet(opening, placed), k).drop("rank"), "first")
    least = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
    rest = asked.join(least, "id", "left").select(*asked.columns, "least").mapInArrow(_visits(pivots, spread, False, threshold), told)
    if visited is not None:
        visited += [d.select(F.col("id").alias("query_id"), "cell") for d in (opening, rest)]
    return _best(first.unionByName(meet(rest, placed)), k)


def _pivots(given: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """For each width up to ``cells`` different vectors, chosen by a hash, as unit rows."""
    turn = Window.partitionBy("width").orderBy("h")
    chosen = given.groupBy("width", F.xxhash64("vector").alias("h")).agg(F.first("vector").alias("vector")).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= cells)
    out: dict[int, list] = {}
    for r in chosen.orderBy("width", "turn").collect():
        out.setdefault(r["width"], []).append(r["vector"])
    return {w: _unit(np.array(rows)) for w, rows in out.items()}


def _unit(rows: np.ndarray) -> np.ndarray:
    top = np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
    rows = rows / top  # no overflow in the squares
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    widths = batch.column("width").to_numpy()
    for w in np.unique(widths).tolist():
        rows = batch.take(pa.array(np.flatnonzero(widths == w)))
        yield w, rows, _matrix(rows)


def _placed(pivots: dict[int, np.ndarray]):
    """Each document's cell and its angle to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, rows, unit in _by_width(batch):
                cell, angle = np.zeros(len(unit), np.int32), np.zeros(len(unit))
                if w in pivots:
                    near = unit @ pivots[w].T
                    cell = near.argmax(axis=1).astype(np.int32)
                    angle = np.arccos(np.clip(near[np.arange(len(unit)), cell], -1.0, 1.0))
                    angle[~unit.any(axis=1)] = 0.0  # zero vectors form a cell of their own
                    cell[~unit.any(axis=1)] = -1
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell), pa.array(angle)], [*rows.schema.names, "cell", "angle"])

    return run


def _visits(pivots: dict[int, np.ndarray], spread: dict[tuple[int, int], tuple[int, float]], opening: bool, threshold: float):
    """The cells that each query visits: that of the highest bound, or all others whose bound reaches the query's least similarity."""
    known: dict[int, list[int]] = {}
    for w, c in sorted(spread):
        if c >= 0:
            known.setdefault(w, []).append(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, rows, unit in _by_width(batch):
                if w not in known:  # a rare width: one cell, seen in the opening
                    found = [(np.arange(len(unit) if opening else 0), np.zeros(len(unit) if opening else 0, np.int32))]
                else:
                    cells = np.array(known[w], np.int32)
                    radius = np.array([spread[w, c][1] for c in known[w]])
                    angle = np.arccos(np.clip(unit @ pivots[w][cells].T, -1.0, 1.0))
                    bound = np.where(unit.any(axis=1)[:, None], np.cos(np.maximum(0.0, angle - radius[None, :] - SLACK)), 0.0) + SLACK
                    best = bound.argmax(axis=1)
                    if opening:
                        found = [(np.arange(len(unit)), cells[best])]
                    else:
                        least = np.nan_to_num(rows.column("least").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                        wanted = bound >= np.maximum(least, threshold)[:, None]
                        wanted[np.arange(len(unit)), best] = False
                        row, col = np.nonzero(wanted)
                        found = [(row, cells[col])]
                        if (w, -1) in spread:  # similarity 0
                            none = np.flatnonzero(np.maximum(least, threshold) <= 0.0)
                            found.append((none, np.full(none.size, -1, np.int32)))
                for row, cell in found:
                    own = rows.drop_columns(["least"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int32())], [*own.schema.names, "cell"])

    return run


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Unit rows of vectors of one width."""
    column = table.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1))


def _partial(k: int, threshold: float):
    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        ids, found = [np.empty(0, np.int64)] * 2 + [np.empty(0)], []
        if asked.num_rows and given.num_rows:
            q, v = _matrix(asked), _matrix(given)
            names, docs = asked.column("id").to_numpy(), given.column("id").to_numpy()
            step = max(1, PAIRS_AT_ONCE // len(docs))
            for at in range(0, len(names), step):
                s = np.round(q[at : at + step] @ v.T, 6)
                most = min(k, s.shape[1])
                # all rows at or above the k-th rounded value, as ties are settled by doc_id
                kth = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
                row, col = np.nonzero((s >= kth[:, None]) & (s >= threshold))
                order = np.lexsort((docs[col], -s[row, col], row))
                row, col = row[order], col[order]
                best = np.arange(row.size) - np.searchsorted(row, row) < k
                row, col = row[best], col[best]
                found.append((names[at + row], docs[col], s[row, col]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else ids
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "doc_id": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float64())})

    return run


def ann_topk(queries: DataFrame, index: VectorIndex, k: int = 4, probes: int = 12, rerank: int = 32, threshold: float = -1.0) -> DataFrame:
    """Approximate top-k by a stored index: (query_id, doc_id, similarity, rank) of (query_id, vector), each query_id once.

    A query probes its ``probes`` nearest cells; of each it keeps the ``rerank * k`` best by the codes
    (``VectorIndex.candidates``), and the best of all these are ranked by their true cosine. Vectors
    that form clusters need few probes; the default suits vectors without any structure.
    """
    near = index.candidates(queries, probes, rerank * k)
    order = Window.partitionBy("query_id").orderBy(F.col("estimate").desc(), "doc_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rerank * k)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("query"))
    exact = index.with_vectors(near.join(asked, "query_id")).select("query_id", "doc_id", F.round(cosine(F.col("query"), F.col("vector")), 6).alias("similarity"))
    return _best(exact.where(F.col("similarity") >= threshold), k)


def merged_ranking(hits: DataFrame, most: int = 10) -> DataFrame:
    """Per job each document once, at its highest similarity; the best ``most``."""
    best = hits.groupBy("job_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("job_id").orderBy(F.col("similarity").desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def stalest(hits: DataFrame) -> DataFrame:
    return hits.groupBy("job_id").agg(F.min("retrieved_at").alias("stalest"))


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, doc_id, similarity, rank): share of a query's distinct terms that a text holds.

    A text holds a term where the term stands in one of its blank-separated tokens, so texts become
    distinct tokens, the distinct tokens of all texts are matched with the terms once, by an
    equi-join on three-character pieces and a check (terms of one or two characters meet by
    pieces of their length), and what matches is joined back by token.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+", -1), lambda t: t != ""))).alias("term"))
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+", -1), lambda t: t != ""))).alias("token"))
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(n)))
    # stored, so a term keeps its number
    first = kept_table(terms.select("term").distinct().withColumns({"piece": F.substring("term", 1, 3), "number": F.monotonically_increasing_id()}), "words")
    every = F.array_union(F.array_union(pieces("token", 3), pieces("token", 2)), pieces("token", 1))
    vocabulary = tokens.select("token").distinct().select("token", F.explode(every).alias("piece"))
    matched = kept_table(vocabulary.join(first, "piece").where(F.contains("token", "term")).groupBy("token").agg(F.collect_set("number").alias("terms")), "matched")
    asked = kept_table(terms.join(sizes, "query_id").join(first.select("term", "number"), "term").drop("term"), "terms")
    small = lambda d: F.broadcast(d) if d.count() <= SMALL else d
    # a text's terms first, each once and by text: far fewer than its tokens; what queries make of them stays where the text is
    held = tokens.join(small(matched), "token").select("doc_id", F.explode("terms").alias("number")).groupBy("doc_id").agg(F.collect_set("number").alias("terms"))
    held = held.select("doc_id", F.explode("terms").alias("number")).join(small(asked), "number")
    share = held.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return _best(share.select("query_id", "doc_id", F.round(F.col("n") / F.col("size"), 6).alias("similarity")), k)


# Query texts by target and module, and for what a script needs.
TARGET_QUERIES = {
    "forge-native": "Atlassian Forge {m} implementation requestJira", "forge-remote": "Atlassian Forge Remote backend {m} timeout",
    "scriptrunner-cloud": "ScriptRunner Cloud Groovy {m} REST API v3", "forge-or-scriptrunner": "Atlassian Forge {m} Cloud migration",
    "manual-rewrite": "Atlassian Cloud {m} manual migration approach",
}
MODULE_QUERIES = {
    "post-function": "Forge workflow post-function trigger issue transition Cloud", "validator": "Forge workflow validator blocking transition Cloud",
    "listener": "Forge async webhook event listener Cloud webhook", "web-panel": "Forge Custom UI React web panel Jira issue panel",
    "scheduled-job": "Forge scheduled trigger cron job Cloud", "jql-function": "Forge JQL function custom search Cloud", "rest-endpoint": "Forge REST endpoint API module Cloud",
}
NEED_QUERIES = {
    "needs_users": "Atlassian Cloud accountId user migration GDPR username deprecated", "needs_fields": "Jira Cloud custom field ID migration Server customfield mapping",
    "has_http": "Atlassian Forge fetch egress external HTTP API calls",
}
SCOPE_QUERY = "Atlassian Forge OAuth scopes {m} manifest.yml permissions"


def build_queries(jobs: DataFrame, most: int = 8) -> DataFrame:
    """(job_id, ord, query) of (job_id, target, module, needs_users, needs_fields, has_http): distinct, in order."""
    filled = lambda t: F.replace(F.lit(t), F.lit("{m}"), F.col("module"))
    by_target, by_module = F, F
    for t, q in TARGET_QUERIES.items():
        by_target = by_target.when(F.col("target") == t, filled(q))
    for m, q in MODULE_QUERIES.items():
        by_module = by_module.when(F.col("module") == m, q)
    texts = F.array(by_target.otherwise(None), by_module.otherwise(None), *[F.when(F.col(c), q) for c, q in NEED_QUERIES.items()], filled(SCOPE_QUERY))
    kept = F.slice(F.array_distinct(F.filter(texts, lambda q: q.isNotNull())), 1, most)
    return jobs.select("job_id", F.posexplode(kept).alias("ord", "query"))


def context_window(ranked: DataFrame, docs: DataFrame, most: int = 8, chars: int = 800) -> DataFrame:
    """(job_id, context): the best documents' starts, in rank order."""
    rows = ranked.where(F.col("rank") <= most).join(docs.select("doc_id", "title", "source", "content"), "doc_id")
    text = F.concat(
        F.lit("\n[DOC "), F.col("rank").cast("string"), F.lit("] "), "title", F.lit("\nSource: "), "source", F.lit("\nRelevance: "),
        F.floor(F.col("similarity") * 100 + 0.5).cast("string"), F.lit("%\n---\n"), F.substring("content", 1, chars),
    )
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("context"))
