"""Ranked lexical search over a length-stratified index.

Documents of one normaliser ``m`` form a stratum; a large stratum is cut into parts of bounded
bytes. Within a part postings are grouped by term and term frequency, so the impact
``(1000000000 * tf) div (1000 * tf + 12 * m)`` is worked out once for a frequency, not once for a
document. An item's bound for a part is the sum of its terms' weights times the impact of the
highest frequency there; no document of the part scores higher.

A search visits each item's parts of the highest bounds first. The lowest score that its best
documents then have is its threshold; of the other parts only those whose bound reaches it are
visited. All scores are whole numbers, so equal bounds and ties need no tolerance.

Index and searches are joins, groupings and shuffles of Spark's; Python turns one document into
counts, one part into postings and one part's postings into scores.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, parallelism, stored, tasks_for

#: Bytes of terms that a part of a stratum has, about, at most (or one document).
PART_BYTES = 8 << 20
#: Bytes that no part need be smaller than.
LEAST_BYTES = 64 << 10
#: Items that meet a part in one task; more items form more blocks.
BLOCK_ITEMS = 1024
#: Parts that an item visits before it has a threshold.
FIRST_VISITS = 4
#: Rows of a table that may be sent to all tasks.
SMALL = 100_000
#: Bytes of the terms that leave a task at a time.
BATCH_BYTES = 4 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII bytes that are neither digits nor letters become a space, A-Z become a-z, bytes beyond ASCII stay.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters + string.digits else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))

COUNTED = "doc_id long, n long, terms array<string>, tfs array<int>"
#: A part has one row without a term, with the ids of its documents, and a row for each term and frequency with places among these.
INDEX = "m long, part int, term string, tf int, places array<int>, docs array<long>"
HITS = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's terms with their frequencies; documents without a term give no row."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            tfs = Counter(terms_of(text.as_py()))
            if tfs:
                told = b" ".join(tfs)
                rows.append((doc.as_py(), sum(tfs.values()), told.decode("utf-8", "replace").split(" "), list(tfs.values())))
                held += len(told)
            if held >= BATCH_BYTES:
                yield _rows(rows)
                rows, held = [], 0
    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "terms", "tfs"])


def _postings(table: pa.Table) -> pa.Table:
    """One part's documents turned into its rows of the index."""
    terms = table.column("terms").combine_chunks()
    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    places = np.repeat(np.arange(table.num_rows), sizes)
    coded = terms.flatten().dictionary_encode()
    codes, tfs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((places, tfs, codes))
    codes, tfs, places = codes[order], tfs[order], places[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(codes) != 0) | (np.diff(tfs) != 0)])
    rows = starts.size + 1
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, codes.size], pa.int32()), pa.array(places, pa.int32()))
    ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("doc_id").combine_chunks())
    named = coded.dictionary.take(pa.array(codes[starts])).cast(pa.string())
    same = lambda c, kind: pa.repeat(pa.scalar(table.column(c)[0].as_py(), kind), rows)
    return pa.table({
        "m": same("m", pa.int64()), "part": same("part", pa.int32()), "term": pa.concat_arrays([pa.nulls(1, pa.string()), named]), "tf": pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(tfs[starts], pa.int32())]),
        "places": pa.concat_arrays([pa.nulls(1, lists.type), lists]), "docs": pa.concat_arrays([ids, pa.nulls(rows - 1, ids.type)]),
    })


@dataclass
class Index:
    """A stored index: the folder of its table, the number of documents with a term, and of their terms with repeats."""

    path: str
    documents: int
    terms: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(INDEX).parquet(self.path)


def build(docs: DataFrame, part_bytes: int = PART_BYTES) -> Index:
    """Index every row of ``docs`` (doc_id, text, ...).

    Texts are read once into counts, counts are dealt once to the parts of their strata. A stratum
    with a third of all documents has as many parts as its bytes ask for; small tables have smaller
    parts, so that every task gets some.
    """
    spark = docs.sparkSession
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = materialize(rows.mapInArrow(_counted, COUNTED), "counted")
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 12)
    told = counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    documents, terms = int(told["documents"]), int(told["terms"])
    most = min(part_bytes, max(LEAST_BYTES, told["bytes"] // (4 * parallelism(spark))))
    sized = counted.withColumn("m", F.lit(75) + F.expr(f"(25 * n * {documents}L) div {max(1, terms)}L"))
    strata = materialize(sized.groupBy("m").agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / most)).cast("int").alias("parts")), "strata")
    strata = F.broadcast(strata) if strata.count() <= SMALL else strata  # one row for each length of text
    # a hash of the counts, so that documents without an id, or of equal ids, spread as well
    own = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.col("parts")).cast("int")
    dealt = sized.join(strata, "m").select("m", own.alias("part"), "doc_id", "terms", "tfs")
    # by both keys: a grouping would be content with a dealing by m alone
    dealt = dealt.repartition(tasks_for(spark, told["bytes"]), "m", "part")
    path = stored(dealt.groupBy("m", "part").applyInArrow(_postings, INDEX), "lexical")
    return Index(path, documents, terms)


def _terms(column: str) -> Column:
    """The terms of a text as an array, as ``terms_of`` gives them."""
    lowered = F.translate(column, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))


def weighed(index: Index, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, block, term, weight), a term's repeats added up, and the rows of the index that hold these terms.

    The weight of a term is floor(1000 * ln((2 * N + 2) / (2 * df + 1))); it is below 50,000 for any
    table, so 64-bit sums hold every score.
    """
    rows = index.rows(items.sparkSession).where("term IS NOT NULL").drop("docs")
    told = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.explode(_terms("text")).alias("term"))
    wanted = materialize(told.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "wanted")
    held = materialize(rows.join(wanted.select("term").distinct(), "term"), "held")
    df = held.groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.documents + 2.0) / (2 * F.col("df") + 1)))
    blocks = -(-max(1, wanted.select("item_id").distinct().count()) // BLOCK_ITEMS)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    return materialize(wanted.join(df, "term").select("item_id", block.alias("block"), "term", (weight * F.col("times")).cast("long").alias("weight")), "weights"), held


def bounds(weights: DataFrame, held: DataFrame) -> DataFrame:
    """(item_id, block, m, part, bound): the most that a document of the part can score for the item."""
    highest = held.groupBy("m", "part", "term").agg(F.max("tf").alias("tf"))
    most = F.sum(F.col("weight") * F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)"))
    return weights.join(highest, "term").groupBy("item_id", "block", "m", "part").agg(most.alias("bound"))


def _visit(k: int):
    """Scores of one part's documents for the items of one block that visit it: each item's best ``k`` that reach its threshold."""

    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        head = pc.is_null(rows.column("term"))
        ids = rows.filter(head).column("docs").combine_chunks().flatten() if rows.num_rows else pa.array([], pa.int64())
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        if len(ids) and visits.num_rows:
            sides = _sides(rows.filter(pc.invert(head)))
            order = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy()  # a document without an id comes last
            for item, terms, weights, least in zip(*(visits.column(c).to_pylist() for c in ("item_id", "terms", "weights", "least")), strict=True):
                scores = np.zeros(len(ids), np.int64)
                for term, weight in zip(terms, weights, strict=True):
                    if term in sides:
                        places, impacts = sides[term]
                        scores[places] += weight * impacts  # a document stands once under a term
                found = np.flatnonzero(scores >= least)
                best = found[np.lexsort((order[found], -scores[found]))[:k]]
                for column, values in zip(out, (np.full(best.size, item, np.int64), best, scores[best]), strict=True):
                    column.append(values)
        item, place, score = (np.concatenate(c) for c in out)
        return pa.table({"item_id": pa.array(item), "doc_id": ids.take(pa.array(place)), "score": pa.array(score)})

    return run


def _sides(postings: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each term the places of its documents and, beside them, their impacts."""
    if not postings.num_rows:
        return {}
    m = int(postings.column("m")[0].as_py())
    lists = postings.column("places").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    places, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    tfs, which = np.unique(postings.column("tf").to_numpy().astype(np.int64), return_inverse=True)
    impacts = ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m))[which]  # once for a frequency
    rows: dict[str, list[int]] = {}
    for row, term in enumerate(postings.column("term").to_pylist()):
        rows.setdefault(term, []).append(row)
    return {t: (np.concatenate([places[ends[r] - sizes[r] : ends[r]] for r in own]), np.repeat(impacts[own], sizes[own])) for t, own in rows.items()}


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 20, first: int = FIRST_VISITS, visited: list[DataFrame] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents for each of ``items`` (item_id, text, ...).

    Every document with a score above 0 is ranked, equal scores by ascending id (without an id
    last); repeated rows are documents of their own and have a rank each. An item without a term,
    or whose terms no document has, gives no row; of items with equal ids the texts count as one.
    Null texts have no terms. Other columns are dropped; an empty table or no items give an empty
    result. ``visited`` receives the parts that both rounds visit, with their bounds.
    """
    spark = items.sparkSession
    weights, held = weighed(index, items)
    bound = materialize(bounds(weights, held), "bounds")
    turn = Window.partitionBy("item_id").orderBy(F.col("bound").desc(), "m", "part")
    opening = materialize(bound.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= first).drop("turn"), "opening")
    told = weights.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    heads = index.rows(spark).where("term IS NULL")

    def seen(parts: DataFrame) -> DataFrame:
        """Hits of the visited parts. Parts that nobody visits stay where they are."""
        keys = parts.select("m", "part", F.col("block").alias("asking")).distinct()
        sent = heads.unionByName(held, allowMissingColumns=True).join(keys, ["m", "part"])
        own = parts.join(told, "item_id").select("m", "part", "block", "item_id", "terms", "weights", "least")
        return sent.groupBy("m", "part", "asking").cogroup(own.groupBy("m", "part", "block")).applyInArrow(_visit(k), HITS)

    early = materialize(_best(seen(opening.withColumn("least", F.lit(1).cast("long"))), k), "early")
    least = early.groupBy("item_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    rest = bound.join(opening.select("item_id", "m", "part"), ["item_id", "m", "part"], "left_anti").join(least, "item_id", "left")
    rest = rest.withColumn("least", F.coalesce("least", F.lit(1))).where(F.col("bound") >= F.col("least"))
    if visited is not None:
        visited += [opening, rest]
    return _best(early.drop("rank").unionByName(seen(rest)), k).select("item_id", "rank", "doc_id", "score")


def sql(k: int = 20) -> str:
    """The same ranking by plain joins."""
    split = lambda c: f"regexp_extract_all(translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {split('text')} AS ts FROM documents WHERE text IS NOT NULL), held AS (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM docs WHERE len(ts) > 0),
 tfs AS MATERIALIZED (SELECT rid, doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL), total AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM docs WHERE len(ts) > 0), dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
 asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({split('text')}) AS term FROM benchmark) GROUP BY ALL),
 weights AS (SELECT item_id, term, times * CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM asked JOIN dfs USING (term), total),
 scores AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score FROM weights JOIN tfs USING (term), total GROUP BY ALL)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {k}"""
