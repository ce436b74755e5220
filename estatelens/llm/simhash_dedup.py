"""SimHash near-dedup over a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of its segments are
a point in a grid of 32 dimensions. The Manhattan distance of two points never exceeds the
Hamming distance of their fingerprints. So fingerprints within 3 bits have a half (16
dimensions) within Manhattan distance 1: the grid join looks each half up in its own cell and
in the cells one step up in one dimension, then pairs that meet are verified exactly.

Equal fingerprints are folded before the join. Cells are worked through in sorted runs and
give back a spanning forest of their links; a cell of many fingerprints is dealt to pairs of
blocks, which different tasks take.

The pipeline links texts by the similarity of their shingles instead (``similar_components``):
near copies differ in more bits than the grid covers, so candidates come from cells of minima,
within a wide radius of their fingerprints, and are verified on the shingles. What those cells
or that radius may miss is found by prefixes of the sorted shingles, which miss no pair
(``prefix_candidates``), and by which texts that are like no other are set aside before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import materialize
from .components import connected_components, spanning_edges

SEED = 42
EVEN_BITS = 0x55555555
#: Members of a cell beyond which it is dealt to pairs of blocks of about this size.
CELL_ROWS = 8192
PAIRS_AT_ONCE = 1 << 21
#: Similar texts: words of a shingle, bands of minima and minima in each (a pair at 0.8 misses all bands with 0.672**24 < 1e-4).
WORDS, BANDS, BAND_ROWS = 5, 24, 5
#: Hamming radius of candidates.
SIMILAR_BITS = 24
#: Members of a group beyond which it is verified in blocks of about this size.
GROUP_ROWS = 512
#: Of n shingles, n // EXTRA more are looked at than one common shingle asks for: so texts that share few are told early.
EXTRA = 10
#: Rows whose texts a task sketches or verifies between two batches it gives back.
ROWS_AT_ONCE = 256
#: A shingle's place in an order: (hash ^ first) * second, second odd.
ORDERS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of all word shingles, repeats included; a text of fewer words is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the six ASCII blanks
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) <= words:
        starts, stops = [0], [len(line)]
    else:
        starts = [0, *(ends[:-words] + 1).tolist()]
        stops = ends[words - 1 :].tolist()
    return np.array([xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    if not hashes.size:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, hashes.size, 4096):
        bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > hashes.size, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over word shingles, repeats included, as a signed 64-bit number."""
    return simhash(shingle_hashes(text, words))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; null and empty texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def segment_counts(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of a 32-bit half, packed into two bits each."""
    return half.bitwiseAND(F.lit(EVEN_BITS)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(EVEN_BITS))


def grid_cells(classes: DataFrame) -> DataFrame:
    """(cell, moved, fp, rep): each half's own cell, and (moved) those one step up."""
    fp = F.col("fp")
    halves = [segment_counts(h) for h in (F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)))]
    cells = []
    for k, half in enumerate(halves):
        base = half + F.lit(k * 2**32)
        cells.append(F.struct(base.alias("cell"), F.lit(0).cast("byte").alias("moved")))
        for i in range(16):
            count = F.shiftrightunsigned(half, 2 * i).bitwiseAND(F.lit(3))
            step = F.when(count < 2, base + F.lit(4**i))
            cells.append(F.struct(step.alias("cell"), F.lit(1).cast("byte").alias("moved")))
    spread = classes.select("fp", "rep", F.explode(F.array(*cells)).alias("c"))
    return spread.where("c.cell IS NOT NULL").select("c.cell", "c.moved", "fp", "rep")


def _run_links(cells: np.ndarray, moved: np.ndarray, fps: np.ndarray, reps: np.ndarray, bits: int) -> np.ndarray:
    """Spanning forest (as rep pairs) of the links in rows sorted by cell and moved."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, cells.size])
    own = np.add.reduceat(moved == 0, starts)
    first = np.repeat(starts, sizes)
    # a row meets the rows of its cell's own half that stand before it
    partners = np.minimum(np.arange(cells.size) - first, np.repeat(own, sizes))
    labels = np.arange(cells.size)
    out = []
    upto = np.cumsum(partners)
    at = 0
    while at < cells.size:
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
        n = partners[at:end]
        b = np.repeat(np.arange(at, end), n)
        a = np.repeat(first[at:end], n) + np.arange(b.size) - np.repeat(np.cumsum(n) - n, n)
        close = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        a, b = a[close], b[close]
        kept = spanning_edges(a, b, labels)
        out.append(np.stack([reps[a[kept]], reps[b[kept]]]))
        at = end
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


def _run_pairs(cells: np.ndarray, components: np.ndarray, reps: np.ndarray, sizes: np.ndarray, places: np.ndarray, least: float) -> np.ndarray:
    """The rep pairs of other components that meet in rows sorted by cell and component, and may have Jaccard similarity ``least``."""
    begins = np.r_[True, cells[1:] != cells[:-1]]
    starts = np.flatnonzero(begins)
    own = np.flatnonzero(begins | np.r_[True, components[1:] != components[:-1]])
    first = np.repeat(starts, np.diff(np.r_[starts, cells.size]))
    # a row meets the rows of its cell that stand before its component
    partners = np.repeat(own, np.diff(np.r_[own, cells.size])) - first
    upto, at, out = np.cumsum(partners), 0, [np.empty((2, 0), np.int64)]
    while at < cells.size:
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
        n = partners[at:end]
        b = np.repeat(np.arange(at, end), n)
        a = np.repeat(first[at:end], n) + np.arange(b.size) - np.repeat(np.cumsum(n) - n, n)
        both = sizes[a] + sizes[b]
        # the shared shingle, and at most all that stand behind it on both sides
        common = 1 + np.minimum(sizes[a] - places[a], sizes[b] - places[b])
        close = (np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]) - 1e-6) & (common * (1 + least) >= least * both - 1e-6)
        out.append(np.unique(np.sort(np.stack([reps[a[close]], reps[b[close]]]), axis=0), axis=1))
        at = end
    return np.unique(np.concatenate(out, axis=1), axis=1)


def _in_runs(columns: tuple[str, ...], found):
    """``found`` of the rows of whole cells, (a, b) pairs, over batches sorted by the first of ``columns``, the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty((0, len(columns)), np.int64)]

        def links(rows: np.ndarray) -> pa.RecordBatch:
            edges = found(*rows.T) if rows.size else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(edges[0], pa.int64()), pa.array(edges[1], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
            last = rows[-1, 0]
            border = int(np.searchsorted(rows[:, 0], last))  # the last cell may go on in the next batch
            if border:
                yield links(np.concatenate([*held, rows[:border]]))
                held = []
            held.append(rows[border:])
        yield links(np.concatenate(held))

    return run


def linked(classes: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b) rep pairs: a spanning forest of the links among distinct fingerprints."""
    return links_in_cells(grid_cells(classes), bits)


def links_in_cells(cells: DataFrame, bits: int) -> DataFrame:
    """(a, b) rep pairs: a spanning forest of the links among rows (cell, moved, fp, rep) that meet in a cell."""
    found = lambda cells, moved, fps, reps: _run_links(cells, moved, fps.astype(np.int64).view(np.uint64), reps, bits)
    return _met(cells, "fp", ("moved", "fp", "rep"), "moved", found)


def _met(cells: DataFrame, dealt_by: str, columns: tuple[str, ...], order: str, found) -> DataFrame:
    """(a, b): what ``found`` gives for the rows (cell, ``columns``) that meet in a cell; crowded cells are dealt to pairs of blocks."""
    crowded = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS)
    crowded = materialize(crowded.select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("blocks")), "crowded")
    dealt = cells.join(crowded, "cell", "left")
    block = F.pmod(F.xxhash64(dealt_by), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != block)
    subs = F.transform(others, lambda x: F.xxhash64("cell", F.least(x, block), F.greatest(x, block)))
    # the names of block pairs are hashes and may meet by chance, which only adds checks
    dealt = dealt.select(F.explode(F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(subs)).alias("sub"), *columns)
    sorted_cells = dealt.repartition("sub").sortWithinPartitions("sub", order)
    return sorted_cells.mapInArrow(_in_runs(("sub", *columns), found), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    Rows link when their fingerprints differ in at most ``bits`` (3 or less) bits; component_id
    is the smallest doc_id reachable. Null and empty texts have fingerprint 0 and link like any
    other; texts of fewer than three words are one shingle. Repeated rows are kept. Rows with a
    null doc_id take the component of their fingerprint. Other columns are dropped. An empty
    table gives an empty result.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the grid join covers distances up to 3")
    own = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    named = connected_components(linked(classes.where("rep IS NOT NULL"), bits)).withColumnRenamed("node", "rep")
    told = classes.join(named, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(told, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def band_cells(distinct: np.ndarray) -> np.ndarray:
    """One cell a band: the minima of ``BAND_ROWS`` orders of the shingles, mixed into one number."""
    with np.errstate(over="ignore"):
        least = np.full(ORDERS.shape[1], np.iinfo(np.uint64).max)
        for k in range(0, distinct.size, 128):
            least = np.minimum(least, ((distinct[k : k + 128, None] ^ ORDERS[0]) * ORDERS[1]).min(axis=0))
        cell = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in least.reshape(BANDS, BAND_ROWS).T:
            cell = (cell ^ column) * ORDERS[1, 0]
            cell ^= cell >> np.uint64(29)
    return cell.view(np.int64)


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``ROWS_AT_ONCE`` at a time: so few texts are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def least_common(size: int, least: float) -> int:
    """How many shingles a set of ``size`` has in common with any set of Jaccard similarity ``least`` or more, at least."""
    return max(1, math.ceil(least * size - 1e-6))


def _sketches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in _few_rows(batches):
            keys, fps, cells, sizes, lows = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                keys.append(hashlib.blake2b(b" ".join(found), digest_size=16).digest())
                distinct = np.unique(shingle_hashes(text, WORDS))
                fps.append(simhash(distinct))
                cells.append(band_cells(distinct))
                sizes.append(distinct.size)
                once = distinct.size and keys[-1] not in seen
                lows.append((distinct[: distinct.size - least_common(distinct.size, least) + 1 + distinct.size // EXTRA] if once else distinct[:0]).view(np.int64))
                seen.add(keys[-1])
            words = np.frombuffer(b"".join(k[:8] for k in keys), np.int64)
            made = [pa.array(keys, pa.binary()), pa.array(words), pa.array(fps, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(lows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("told"), *made], ["doc_id", "told", "key", "word", "fp", "cells", "size", "low"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (low, word), equal ones counted once, those whose ``low`` another word has too."""
    low, word, size = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)  # of the row that the next batch may share
    given = False
    for batch in batches:
        if not batch.num_rows:
            continue
        low, word, size = (np.r_[held, batch.column(c).to_numpy(zero_copy_only=False)] for held, c in ((low, "low"), (word, "word"), (size, "size")))
        new = np.r_[True, (low[1:] != low[:-1]) | (word[1:] != word[:-1])]
        low, word, size = low[new], word[new], size[new]
        same = low[1:] == low[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        told = shared.copy()
        told[0] &= not given
        yield pa.RecordBatch.from_arrays([pa.array(word[told], pa.int64()), pa.array(size[told], pa.int32())], ["word", "size"])
        # a row held alone again is still given if it was
        given = bool(shared[-1]) or (given and low.size == 1)
        low, word, size = low[-1:], word[-1:], size[-1:]


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, rep, size): the distinct shingles of each text."""
    for batch in _few_rows(batches):
        sets = [np.unique(shingle_hashes(t, WORDS)).view(np.int64) for t in batch.column("text").to_pylist()]
        sizes = np.array([x.size for x in sets], np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        reps = batch.column("rep").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(reps, sizes)), pa.array(np.repeat(sizes, sizes))], ["cell", "rep", "size"])


def verified_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (sorted, distinct) with Jaccard similarity of ``least`` or more."""
    sizes, labels, out = np.array([s.size for s in sets]), np.arange(len(sets)), []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, own in enumerate(sets):
        apart = labels != labels[i]
        if not apart.any():
            continue
        low = np.searchsorted(flat, own, "left")
        n = np.searchsorted(flat, own, "right") - low
        common = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for j in np.flatnonzero(apart & (common > 0) & (common >= least * (sizes + own.size - common) - 1e-9)).tolist():
            if labels[j] != labels[i]:
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return out


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, reps, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = verified_links(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([reps[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in _few_rows(batches):
            for sub, rep, text in zip(*(batch.column(c).to_pylist() for c in ("sub", "rep", "text")), strict=True):
                if sub != group:
                    if len(sets) > 1:
                        yield links()
                    group, reps, sets = sub, [], []
                reps.append(rep)
                sets.append(np.unique(shingle_hashes(text, WORDS)))
        yield links()

    return run


def _linked_texts(texts: DataFrame, dealt: DataFrame, least: float) -> DataFrame:
    """(a, b): verified links of the texts (rep, text) that ``dealt`` (rep, subs) sends to the same sub."""
    sent = texts.join(dealt, "rep").select(F.explode("subs").alias("sub"), "rep", "text")
    return materialize(sent.repartition("sub").sortWithinPartitions("sub").mapInArrow(_verify(least), "a long, b long"), "verified")


def _fewest(least: float) -> Column:
    """``least_common`` of the column ``size``."""
    return F.greatest(F.lit(1), F.ceil(F.lit(least) * F.col("size") - 1e-6)).cast("int")


def _with_shared(own: DataFrame, least: float) -> DataFrame:
    """(key): the classes that may have Jaccard similarity ``least`` or more with another one.

    Two sets that alike share one of the first ``size - least_common + 1`` shingles of both in any
    common order, and k more of them for k shingles more. ``own`` has the first by hash (low): a text
    of which too few are shared is like no other.
    """
    lows = own.select(F.explode("low").alias("low"), "word", "size")
    shared = lows.repartition("low").sortWithinPartitions("low", "word").mapInArrow(_shared, "word long, size int")
    met = shared.groupBy("word", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.floor(_fewest(least) / EXTRA))
    return materialize(own.select("key", "word").join(met.select("word"), "word", "left_semi").select("key").distinct(), "met")


def prefix_candidates(texts: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs that hold every one of Jaccard similarity ``least`` or more whose texts ``known`` (rep, component) does not link.

    The first shingles, as in ``_with_shared``, with the rarest first, so that a common line or
    passage brings no pairs.
    """
    shingles = materialize(texts.mapInArrow(_shingles, "cell long, rep long, size int"), "shingles").repartition("cell")
    often = shingles.groupBy("cell").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("rep")
    # a shingle that no other text has stands before all others
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "cell"))
    first = shingles.join(often, "cell").withColumn("place", place).where(F.col("place") <= F.col("size") - _fewest(least) + 1)
    cells = first.select("cell", "rep", "size", "place").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    cells = materialize(cells, "prefixes")
    apart = cells.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("cell")
    found = lambda *columns: _run_pairs(*columns, least)
    return materialize(_met(cells.join(apart, "cell", "left_semi"), "rep", ("component", "rep", "size", "place"), "component", found).distinct(), "candidates")


def _links_of_candidates(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b): verified links of candidate pairs; a text meets its partners in blocks of about ``GROUP_ROWS``."""
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("blocks"))
    named = pairs.join(n, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))).alias("sub"))
    sides = named.select(F.col("a").alias("rep"), "sub").unionByName(named.select(F.col("b").alias("rep"), "sub"))
    return _linked_texts(texts, sides.groupBy("rep").agg(F.collect_set("sub").alias("subs")), least)


def _told(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_told``, which tells texts of one doc_id apart."""
    return docs.withColumn("_told", F.xxhash64("text"))


def _components(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) and classes of equal words (key, head, top): the first row of the class, and of its component.

    A first row is a struct (no_id, doc_id, told): the smallest doc_id, rows without one last.
    """
    texts = _told(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumnRenamed("_told", "told")
    own = materialize(texts.mapInArrow(_sketches(least), "doc_id long, told long, key binary, word long, fp long, cells array<long>, size int, low array<long>"), "sketches")
    classes = own.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "told")).alias("head"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # stored, so numbers stay
    is_first = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("told") == F.col("_told"))
    # what follows is for classes that may be like another one only
    met = classes.join(_with_shared(own, least), "key", "left_semi").select("key", "rep", F.col("head.doc_id").alias("_id"), F.col("head.told").alias("_told"))
    heads = own.select("key", "doc_id", "told", "fp", "cells").join(met, "key").where(is_first)
    met = materialize(met.drop("key"), "met")
    texts = materialize(texts.join(met, is_first).select("rep", "text").dropDuplicates(["rep"]), "texts")
    links = _similar_links(texts, heads, least)
    known = connected_components(links)
    pairs = prefix_candidates(texts, known.withColumnRenamed("node", "rep"), least)
    more = _links_of_candidates(texts, pairs, least)
    if not more.isEmpty():
        known = connected_components(links.unionByName(more))
    named = classes.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "rep")), "named")
    tops = named.groupBy("component").agg(F.min("head").alias("top"))
    return own.select("doc_id", "key"), named.join(tops, "component").select("key", "head", "top")


def _similar_links(texts: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """(a, b): links of texts whose five-word shingles have Jaccard similarity ``least`` or more, by their sketches.

    Candidates share a cell of minima and differ in at most ``SIMILAR_BITS`` bits of their SimHash
    over distinct shingles. What candidates connect is a group, and inside a group every pair is
    verified on the shingles themselves (pairs already connected need not be). A group of more
    than ``GROUP_ROWS`` texts is first dealt to blocks, which all get the group's smallest id;
    what then stands apart from the group's largest component meets all its blocks.
    """
    cells = heads.select(F.explode("cells").alias("cell"), F.lit(0).cast("byte").alias("moved"), "fp", "rep")
    groups = connected_components(links_in_cells(cells, SIMILAR_BITS)).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    sizes = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("blocks"))
    groups = materialize(groups.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "groups")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # names of subs are hashes and may meet by chance, which only adds checks
    first = F.when(F.col("rep") == F.col("grp"), upto(F.col("blocks"))).otherwise(F.array("block"))
    links = _linked_texts(texts, groups.select("rep", F.transform(first, lambda b: F.xxhash64("grp", b)).alias("subs")), least)
    # groups of several blocks: whoever is not in the largest component meets everyone
    known = connected_components(links).withColumnRenamed("node", "rep")
    parts = materialize(groups.where("blocks > 1").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "parts")
    counts = parts.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    largest = largest.select("grp", F.col("top.component").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / GROUP_ROWS).cast("int").alias("sides")).where("sides > 0")
    open_ = parts.join(largest, "grp")
    side = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("sides")).cast("int")
    as_all = F.transform(upto(F.col("sides")), lambda s: F.xxhash64("grp", "block", s))
    as_side = F.transform(upto(F.col("blocks")), lambda b: F.xxhash64("grp", b, side))
    subs = F.when(F.col("component") != F.col("top"), F.array_union(as_all, as_side)).otherwise(as_all)
    more = _linked_texts(texts, open_.select("rep", subs.alias("subs")), least)
    return links.unionByName(more)


def similar_components(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row: texts whose five-word shingles have Jaccard similarity ``least`` or more link.

    component_id is the smallest doc_id reachable, null if no text there has one.
    """
    own, classes = _components(docs, least)
    return own.join(classes, "key").select("doc_id", F.col("top.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of each component of similar texts, with all columns: that of the smallest doc_id, rows without one last.

    Texts of one doc_id are judged one by one. Of rows of equal doc_id and text one stays.
    """
    _, classes = _components(docs, least)
    keep = classes.where("head = top").select(F.col("top.doc_id").alias("_kept_id"), F.col("top.told").alias("_kept"))
    told = _told(docs)
    kept = told.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (told["_told"] == keep["_kept"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_told"]).drop("_told")
