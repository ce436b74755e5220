"""Token-id files with directly addressable codes.

A segment holds the ids of consecutive documents. Each id is split into bytes: level 0 keeps
the lowest byte of every id, and a bitmap tells which ids go on; level 1 keeps the next byte
of those only, and so on for as many levels as the largest id needs. A rank directory counts
the set bits before each block of 512, so the place of an id in the next level is found in
constant time: any token can be read without decoding its neighbours.

Segment image, little-endian: magic ``DAC1``, u32 number of ids, u8 number of levels; for each
level u32 number of chunks, the chunks (a byte each), and unless it is the last level the
bitmap (bytes, lowest bit first) and the rank directory (u32 per 512 bits).

Segments are the binary column of a Parquet table in the shared folder, which any store that
Spark writes to can hold; a row has the segment's part and piece, the ids of its part before
it, its documents and their lengths. Parquet is told not to compress or encode that column, so
the images lie in the files byte for byte.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, parallelism, shared_dir
from .tokens import encoder, vocabulary_path

MAGIC = b"DAC1"
RANK_BLOCK = 512
#: Ids of a segment beyond which the next document starts a new one.
SEGMENT_IDS = 1 << 18
END_ID = 2
#: Bytes of text that a part, which one task writes, has about.
PART_BYTES = 64 << 20
#: Parts whose sums one task adds up.
PARTS_AT_ONCE = 1000
#: Parts whose starts are sent to all tasks; those of more parts are joined by shuffles.
SMALL = 100_000
SEGMENTS = "part int, piece int, part_start long, n_ids long, image binary, doc_ids array<long>, lengths array<long>"


def encode_segment(ids: np.ndarray) -> bytes:
    rest = np.asarray(ids, np.uint32)
    levels = max(1, -(-int(rest.max(initial=0)).bit_length() // 8))
    out = [MAGIC, struct.pack("<IB", rest.size, levels)]
    for level in range(levels):
        out += [struct.pack("<I", rest.size), rest.astype(np.uint8).tobytes()]
        rest = rest >> 8
        if level + 1 < levels:
            more = rest > 0
            out += [np.packbits(more, bitorder="little").tobytes(), _ranks(more).tobytes()]
            rest = rest[more]
    return b"".join(out)


def _ranks(more: np.ndarray) -> np.ndarray:
    """Set bits before each block."""
    per_block = np.add.reduceat(more, np.arange(0, more.size, RANK_BLOCK), dtype=np.int64) if more.size else np.empty(0, np.int64)
    return (np.cumsum(per_block) - per_block).astype("<u4")


class SegmentReader:
    """Reads ids at any positions of a segment image."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.size, levels = struct.unpack_from("<IB", image, 4)
        at, self.levels = 9, []
        for level in range(levels):
            (n,) = struct.unpack_from("<I", image, at)
            chunks = np.frombuffer(image, np.uint8, n, at + 4)
            at += 4 + n
            bitmap = ranks = None
            if level + 1 < levels:
                bitmap = np.frombuffer(image, np.uint8, -(-n // 8), at)
                ranks = np.frombuffer(image, "<u4", -(-n // RANK_BLOCK), at + bitmap.nbytes)
                at += bitmap.nbytes + ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def token(self, position: int) -> int:
        """One id: a chunk, a bit and a rank per level."""
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[position]) << shift
            if bitmap is None or not bitmap[position >> 3] >> (position & 7) & 1:
                break
            block = position // RANK_BLOCK
            within = np.unpackbits(bitmap[block * RANK_BLOCK // 8 : (position >> 3) + 1], bitorder="little")
            position = int(ranks[block]) + int(within[: position - block * RANK_BLOCK].sum())
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        """All ids in order."""
        below = None
        for chunks, bitmap, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            if bitmap is not None:
                more = np.unpackbits(bitmap, count=chunks.size, bitorder="little").astype(bool)
                out[more] |= below << np.uint32(8)
            below = out
        return below


def _write_segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(path).encode
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = piece = before = 0

        def segment() -> pa.RecordBatch:
            image = encode_segment(np.concatenate(ids))
            lengths = [x.size for x in ids]
            columns = [pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([before], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([image], pa.binary()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["part", "piece", "part_start", "n_ids", "image", "doc_ids", "lengths"])

        for batch in batches:
            for doc, own in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                if held >= SEGMENT_IDS:
                    yield segment()
                    ids, docs, held, piece, before = [], [], 0, piece + 1, before + held
                ids.append(np.append(own, np.array(end_id, own.dtype)))
                docs.append(doc)
                held += own.size + 1
        if docs:
            yield segment()

    return run


def write_token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> str:
    """Write the ids of ``docs`` (doc_id, text, ...) in ascending doc_id order; returns the table's path.

    A null text is the empty text, whose only id is ``end_id``. Null ids come first; repeated rows
    are written each, equal ids in the order of their text's hash. Other columns are dropped. An
    empty table gives an empty file set.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(parallelism(spark), -(-size // PART_BYTES)), *order).sortWithinPartitions(*order)
    segments = ranged.mapInArrow(_write_segments(vocabulary or vocabulary_path(), end_id), SEGMENTS)
    segments.write.option("compression", "none").option("parquet.enable.dictionary#image", "false").parquet(path)
    return path


def segments_with_starts(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids before each.

    A segment knows how many ids of its part stand before it; the ids of the parts before are
    summed over a row for each task of the write, and sent to where the segments lie, unless there
    are more than ``SMALL`` of them. Until then images do not move.
    """
    table = spark.read.schema(SEGMENTS).parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    blocks = totals.select("part", "ids", F.floor(F.col("part") / PARTS_AT_ONCE).alias("block"))
    within = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for a thousand parts
    of_blocks = blocks.groupBy("block").agg(F.sum("ids").alias("ids")).select("block", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("block_start"))
    starts = blocks.join(of_blocks, "block").select("part", (F.col("block_start") + F.coalesce(F.sum("ids").over(within), F.lit(0))).alias("before"))
    starts = materialize(starts, "starts")
    starts = F.broadcast(starts) if starts.count() <= SMALL else starts
    return table.join(starts, "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image, docs, lengths, start in zip(*(batch.column(c).to_pylist() for c in ("image", "doc_ids", "lengths", "start")), strict=True):
            ids = SegmentReader(image).ids().astype("<u4")
            ends = np.cumsum(lengths)
            own = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(own, pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids as little-endian 32-bit numbers."""
    located = segments_with_starts(spark, path).select("image", "doc_ids", "lengths", "start")
    return located.mapInArrow(_read_documents, "doc_id long, start long, n_tokens long, ids binary")


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[int] = []
        for image, start, positions in zip(*(batch.column(c).to_pylist() for c in ("image", "start", "positions")), strict=True):
            reader = SegmentReader(image)
            found += [reader.token(p - start) for p in positions]
        asked = [p for ps in batch.column("positions").to_pylist() for p in ps]
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int32())], ["position", "token"])


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, token) for a short list of global positions; only their segments are opened."""
    wanted = F.array(*[F.lit(int(p)).cast("long") for p in positions]) if positions else F.array().cast("array<long>")
    inside = F.filter(wanted, lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_ids")))
    asked = segments_with_starts(spark, path).withColumn("positions", inside).where(F.size("positions") > 0)
    return asked.select("image", "start", "positions").mapInArrow(_lookup, "position long, token int")

