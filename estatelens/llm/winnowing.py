"""Document fingerprints by winnowing.

Every run of ``K`` code points has a rolling hash; of each window of ``WINDOW`` successive
hashes the smallest is chosen, the rightmost of equal ones, and kept with its position. Any
passage of ``WINDOW + K - 1`` code points that two texts share is then guaranteed to have a
fingerprint in both. Texts with fewer than ``WINDOW`` hashes are one window, texts shorter
than ``K`` one hash; the empty text has no fingerprint. Hashes have 48 bits, so that chance
hardly ever makes two grams of a large corpus alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism

K, WINDOW = 12, 12
HASH_BITS = 48
#: Code points whose rows a task gives back at a time.
BATCH_CHARS = 1 << 20
#: Parts that a task sorts, on average: ids are dealt to tasks by hash of their part.
PARTS_PER_TASK = 4
#: Bytes of text in a part, on average, at most.
PART_BYTES = 128 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-grams: a polynomial over doubling spans, then mixed."""
    k = min(k, codes.size)
    if not k:
        return np.empty(0, np.uint64)
    # hash(i, n) covers n code points from i; hash(i, a + b) = hash(i, a) * BASE**b + hash(i + a, b)
    with np.errstate(over="ignore"):
        spans, power, out, length = codes.astype(np.uint64) + np.uint64(1), BASE, None, 0
        have, bit = 1, k
        while bit:
            if bit & 1:
                if out is None:
                    out = spans
                else:
                    n = codes.size - (length + have) + 1
                    out = out[:n] * power + spans[length : length + n]
                length += have
            bit >>= 1
            if bit:
                n = codes.size - 2 * have + 1
                spans = spans[:n] * power + spans[have : have + n]
                power, have = power * power, have * 2
        out = (out ^ (out >> np.uint64(31))) * MIX
    return out >> np.uint64(64 - HASH_BITS)


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions chosen: the rightmost smallest hash of every window, each once, in order."""
    if not hashes.size:
        return np.empty(0, np.int64)
    window = min(window, hashes.size)
    # doubling spans as for the hashes: the place of the smallest of each span, of equal ones the right one
    at, have = np.arange(hashes.size), 1
    while have < window:
        step = min(have, window - have)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] <= hashes[left], right, left)
        have += step
    return at[np.r_[True, at[1:] != at[:-1]]]  # positions chosen never go back


def fingerprint(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the winnowed k-grams."""
    hashes = gram_hashes(codes, k)
    at = winnowed(hashes, window)
    return hashes[at], at


def as_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Sixteen hex digits a fingerprint: twelve of the hash, four of the steps from the position before, less one.

    The steps are at most ``WINDOW``, or the first position.
    """
    hashes, at = print_
    return ((hashes << np.uint64(16)) | (np.diff(at, prepend=-1) - 1).astype(np.uint64)).astype(">u8").tobytes().hex()


def from_text(told: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a fingerprint that ``as_text`` wrote."""
    both = np.frombuffer(bytes.fromhex(told), ">u8").astype(np.uint64)
    return both >> np.uint64(16), np.cumsum((both & np.uint64(0xFFFF)).astype(np.int64) + 1) - 1


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of the sets of hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    if not a.size + b.size:
        return 1.0
    return 2.0 * np.intersect1d(a, b, assume_unique=True).size / (a.size + b.size)


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last third of the code points replaced by as many (or all) from the start of the next text."""
    cut = codes.size // 3
    return np.concatenate([codes[: codes.size - cut], following[:cut]])


def _row(doc: int | None, codes: np.ndarray, own: tuple, following: np.ndarray, next_hashes: np.ndarray) -> tuple:
    changed = edited(codes, following)
    other = fingerprint(changed)
    told = changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return doc, codes.size, hashlib.sha256(told).hexdigest(), as_text(own), as_text(other), likeness(own[0], other[0]), likeness(own[0], next_hashes)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(COLUMNS))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, then head, then descending doc_id: each text meets the one after it.

    The head of the next part stands at the end of each part, for its last text. Rows are given
    back ``BATCH_CHARS`` of text at a time.
    """
    part = before = None  # before: doc, codes, fingerprint
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for own_part, head, doc, text in zip(*(batch.column(c) for c in ("part", "head", "doc_id", "text")), strict=True):
            own_part = own_part.as_py()
            if own_part != part:
                part, before = own_part, None
            elif before is None:
                continue  # the part ended with the first of its heads
            codes = code_points(text.as_py())
            own = fingerprint(codes)
            if before is not None:
                rows.append(_row(*before, codes, own[0]))
                held += codes.size
            if held >= BATCH_CHARS:
                yield _batch(rows)
                rows, held = [], 0
            before = None if head.as_py() else (doc.as_py(), codes, own)
    yield _batch(rows)


def _parts(splits: np.ndarray, hash_splits: np.ndarray):
    """Parts of rows: they count from the largest ids down; rows without an id follow, from the smallest text hashes up."""

    def parts(known: pd.Series, key: pd.Series) -> np.ndarray:
        by_id = splits.size - np.searchsorted(splits, key, side="left")
        by_hash = splits.size + 1 + np.searchsorted(hash_splits, key, side="right")
        return np.where(known, by_id, by_hash).astype(np.int32)

    return parts


def compare_with_edits(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text, ...) and of its edited text, and their likeness.

    The next document is the one of the next lower doc_id, after the last the first. Splits near
    quantiles of the ids cut the table into parts of about ``part_bytes``, or into a few for each
    task; each part is sorted in one task, and the row that heads a part is also sent to the part
    before, so texts move once. The splits and one row for each part are all that the driver sees.
    A null text is the empty text. Equal ids follow one another by text hash, null ids come last, in
    the order of their text hashes, by which they are cut into parts too; a lone document is its own
    next. Other columns are dropped; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    unknown = F.col("doc_id").isNull()
    size, nulls = rows.agg(F.sum(F.octet_length("text")), F.count_if(unknown)).first()
    parts = max(PARTS_PER_TASK * parallelism(spark), -(-(size or 0) // part_bytes))
    shares = [(k + 1) / parts for k in range(parts - 1)] or [0.5]
    quantiles = lambda c: F.percentile_approx(c, shares, max(10_000, 4 * parts))
    # without null ids the text is not read for a hash of it
    keyed = rows.select("doc_id", "text", (~unknown).alias("known"), F.coalesce("doc_id", F.xxhash64("text")).alias("key") if nulls else F.col("doc_id").alias("key"))
    found = keyed.agg(quantiles(F.when(F.col("known"), F.col("key"))), quantiles(F.when(~F.col("known"), F.col("key")))).first()
    splits, hash_splits = (np.array(sorted(set(c or [])), np.int64) for c in found)
    parts_of = _parts(splits, hash_splits)

    @F.pandas_udf("int")
    def part_of(known: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(parts_of(known, key))

    ends = keyed.groupBy(part_of("known", "key").alias("own"), "known").agg(F.max("key").alias("top"), F.min("key").alias("bottom")).collect()  # a row for each part
    there = np.array(sorted(r["own"] for r in ends), np.int64)
    earlier = np.full(splits.size + hash_splits.size + 2, -1, np.int32)
    earlier[there] = np.roll(there, 1)
    top, bottom = np.array([r["top"] for r in ends if r["known"]], np.int64), np.array([r["bottom"] for r in ends if not r["known"]], np.int64)

    @F.pandas_udf("own int, before int, heads boolean")
    def place(known: pd.Series, key: pd.Series) -> pd.DataFrame:
        own = parts_of(known, key)
        return pd.DataFrame({"own": own, "before": earlier[own], "heads": np.where(known, np.isin(key, top), np.isin(key, bottom))})

    to = lambda part, head: F.struct(F.col(f"at.{part}").alias("part"), F.lit(head).alias("head"))
    placed = keyed.select("doc_id", "text", place("known", "key").alias("at"))
    both = F.when(F.col("at.heads"), F.array(to("own", False), to("before", True))).otherwise(F.array(to("own", False)))
    sent = placed.select("doc_id", "text", F.explode(both).alias("to"))
    sent = sent.select("to.part", "to.head", "doc_id", "text").repartition(-(-parts // PARTS_PER_TASK), "part")
    ordered = sent.sortWithinPartitions("part", "head", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return ordered.mapInArrow(_compare, RESULT)


def shared_passages(a: str, b: str, k: int = K, window: int = WINDOW) -> list[tuple[int, int]]:
    """Positions (in a, in b) of equal k-grams that both fingerprints keep."""
    (ha, pa_), (hb, pb) = fingerprint(code_points(a), k, window), fingerprint(code_points(b), k, window)
    places: dict[int, list[int]] = {}
    for h, p in zip(hb.tolist(), pb.tolist(), strict=True):
        places.setdefault(h, []).append(p)
    return [(p, q) for h, p in zip(ha.tolist(), pa_.tolist(), strict=True) for q in places.get(h, ()) if a[p : p + k] == b[q : q + k]]
