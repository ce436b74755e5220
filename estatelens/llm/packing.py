"""Packing into fixed-length sequences by best-two-fit, decided on counts of lengths.

Which pieces share a sequence depends on their lengths alone, and lengths are at most the
capacity. So the rule runs over the number of pieces of each length (``capacity`` numbers at
most, whatever the corpus): a bin is filled greedily with the longest piece that fits, then
its smallest piece gives way to two unpacked ones that together fill the expanded gap more
tightly. A bin made so is repeated for as long as its lengths last, which the rule would do
anyway, and gives a run of equal sequences. The runs are few: each ends because a length
gives out, and a length that is short of k pieces ends at most k runs. Their table has a
proven bound, independent of the corpus, and is sent to the tasks, where a piece finds its
sequence by its number among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, gapless_rank, give_back, materialize, numbered, tasks_for
from .tokens import encoder, vocabulary_path

CAPACITY = 4096
END_ID = 1
#: Bytes of ids that a task gives back at a time.
BATCH_BYTES = 4 << 20
#: Documents that follow one another in the order of their table and are ranked together.
BUCKET_ROWS = 4096


def fill(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences), by best-two-fit. counts[n]: pieces of length n."""
    left = counts.astype(np.int64).copy()
    capacity = left.size - 1
    runs = []
    while True:
        there = np.flatnonzero(left)
        if not there.size:
            return runs
        gap, own = capacity, []
        take = left.copy()
        while gap:
            k = int(np.searchsorted(there, gap, side="right")) - 1
            while k >= 0 and not take[there[k]]:
                k -= 1
            if k < 0:
                break
            n = int(there[k])
            times = int(min(take[n], gap // n))
            own += [n] * times
            take[n] -= times
            gap -= n * times
        looked_at = left - take  # what the greedy part wants to find there
        if gap:  # a full bin has no gap to close
            least = own[-1]
            pair = _tightest_pair(take, least, gap + least)
            if pair:
                own = [*own[:-1], *pair]
                np.add.at(looked_at, pair, 1)
        lengths, need = np.unique(own, return_counts=True)
        # as long as a next bin finds all that this one looked at, the piece given back included
        times = int(((left[lengths] - looked_at[lengths]) // need).min()) + 1
        left[lengths] -= need * times
        runs.append((sorted(own, reverse=True), times))


def _tightest_pair(take: np.ndarray, least: int, room: int) -> list[int] | None:
    """Two unpacked lengths with the largest sum in (least, room]."""
    there = np.flatnonzero(take[: room + 1])
    if there.size == 0:
        return None
    mate = np.searchsorted(there, room - there, side="right") - 1
    # a length pairs with itself only if two pieces have it
    clash = (mate >= 0) & (there[np.maximum(mate, 0)] == there) & (take[there] < 2)
    mate = np.where(clash, mate - 1, mate)
    fits = mate >= 0
    if not fits.any():
        return None
    first, second = there[fits], there[mate[fits]]
    best = int(np.argmax(first + second))
    return [int(first[best]), int(second[best])] if first[best] + second[best] > least else None


def _piece_batch(rows: list[tuple], carried: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * len(carried)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids", *carried])


def _pieces(path: str, end_id: int, capacity: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            also = zip(*(batch.column(c).to_pylist() for c in carried), strict=True) if carried else repeat((), batch.num_rows)
            for doc, own, more in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), also, strict=True):
                own = np.append(own.astype("<u4"), np.array(end_id, "<u4"))
                rows += [(doc, n, k, min(capacity, own.size - k), own[k : k + capacity].tobytes(), *more) for n, k in enumerate(range(0, own.size, capacity))]
                held += own.nbytes
                if held >= BATCH_BYTES:
                    yield _piece_batch(rows, carried)
                    rows, held = [], 0
            give_back()
        if rows:
            yield _piece_batch(rows, carried)
        give_back()

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, carried: list[str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids with the end id, cut at ``capacity``.

    A null text is the empty text, one piece of the end id alone. Repeated rows give pieces of
    their own, null ids stay null, other columns than ``carried`` (whole numbers) are dropped; an
    empty table gives no pieces.
    """
    batches_by_bytes(docs.sparkSession)
    carried = carried or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    kinds = ", ".join(["doc_id long, piece int, start long, length long, ids binary", *(f"{c} long" for c in carried)])
    return rows.mapInArrow(_pieces(vocabulary or vocabulary_path(), end_id, capacity, carried), kinds)


def place(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None, buckets: Column | None = None) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length from 1 to capacity, any other columns).

    ``pieces`` must be stored (it is read three times). Sequences use offsets without gaps from 0.
    Pieces of a length take its places in any order, or in that of ``order`` if ``buckets`` rises with it.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # ``capacity`` rows at most
        counts[r["length"]] = r["count"]
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, np.int64)
    base = 0
    for own, times in fill(counts):
        offset = 0
        for n in sorted(set(own), reverse=True):
            each = own.count(n)
            slots.setdefault(n, []).append((int(used[n]), base, each, offset, times))
            used[n] += each * times
            offset += n * each
        base += times
    table = {n: tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) for n, rows in slots.items()}
    sent = spark.sparkContext.broadcast(table)
    held = 4 * int((counts * np.arange(capacity + 1)).sum())  # bytes of all ids: one length may have most of them
    ranked = gapless_rank(pieces, ["length"], order or ["doc_id", "piece"], "_rank", tasks_for(spark, held) if buckets is None else buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
            for n in np.unique(lengths):
                rows = lengths == n
                firsts, bases, each, offsets, _ = sent.value[int(n)]
                at = np.searchsorted(firsts, ranks[rows], side="right") - 1
                within = ranks[rows] - firsts[at]
                sequence[rows] = bases[at] + within // each[at]
                offset[rows] = offsets[at] + within % each[at] * n
            kept = [c for c in batch.schema.names if c != "_rank"]
            give_back()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def stored_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """``token_pieces`` written to the shared folder, as ``place`` needs them."""
    return materialize(token_pieces(docs, capacity, end_id, vocabulary), "pieces")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece with its place, in the order of ``docs``.

    Lengths alone decide which places there are. Among pieces of a length, and so in each run of
    equal sequences, the earlier document comes first; sequences are numbered without gaps in the
    order of their first documents. Places are worked out without the ids, which move once.
    """
    pieces = materialize(token_pieces(numbered(docs), capacity, end_id, vocabulary, ["_at", "_row"]), "pieces")
    block = F.expr(f"_at div {BUCKET_ROWS}")
    placed = materialize(place(pieces.select("_at", "_row", "piece", "length"), capacity, ["_at", "_row", "piece"], block), "places")
    firsts = placed.groupBy("sequence_id").agg(F.min("_at").alias("_at")).withColumn("_all", F.lit(0))
    turns = gapless_rank(firsts, ["_all"], ["_at", "sequence_id"], "_turn", block).select("sequence_id", "_turn")
    placed = placed.join(turns, "sequence_id").select("_row", "piece", F.col("_turn").alias("sequence_id"), "offset")
    return pieces.join(placed, ["_row", "piece"]).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, ids joined in the order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has ``capacity`` ids at most
    return placed.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("ids")).select(
        "sequence_id", F.unhex("ids").alias("ids")
    )
