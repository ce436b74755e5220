"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks of equal bytes: a document belongs to the block in which
its first byte lies, so a block's slot stands for its bytes however long its documents are, and
a long document covers several slots. Blocks have ``BLOCK_BYTES`` or, in a large corpus, one part
in ``MOST_BLOCKS`` of its bytes; the driver orders that many at most. In a fluid mix every source that lasts flows at its weight's
share of the sources that last, so of a source with weight w block j flows from virtual time
j / w to (j + 1) / w, whatever ends in between. Its window are the slots that touch this stretch;
in every slot the released block with the earliest deadline goes next. Such an order exists for
any weights, and keeps each source less than one block away from its fluid amount in every
prefix of the mix. Weights are taken as they are and windows are worked out in whole numbers,
so nothing is rounded and no deviation adds up.

Nothing is dropped or repeated. Within a source documents go in the order of their id's hash.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from fractions import Fraction
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_sum, tasks_for

#: Bytes of a block, at least.
BLOCK_BYTES = 16 << 10
#: Blocks that the corpus is cut into, at most, beside one for each source; their order takes the driver about two seconds.
MOST_BLOCKS = 1 << 20
#: Blocks of a source that one row of the schedule has.
RUN_BLOCKS = 1024


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratio of ``weights``; what has no weight comes far behind the smallest."""
    least = min((w for w in weights if w > 0), default=1.0)
    ratios = [Fraction(w if w > 0 else least) / (1 if w > 0 else 1 << 64) for w in weights]
    scale = max((r.denominator for r in ratios), default=1)  # all are powers of two
    return [int(r * scale) for r in ratios]


def place_blocks(blocks: list[int], weights: list[float]) -> list[tuple[array, array, array]]:
    """(releases, deadlines, slots) of each source's blocks, earliest deadline first."""
    whole, total = whole_weights(weights), sum(blocks)
    shift = 2 * max(whole, default=1).bit_length() + 1  # so that unequal virtual times stay unequal when cut to whole numbers
    order = sorted(range(len(blocks)), key=lambda s: (blocks[s] << shift) // whole[s])
    ends = [(blocks[s] << shift) // whole[s] for s in order]
    given = list(accumulate((blocks[s] for s in order), initial=0))
    flowing = list(accumulate((-whole[s] for s in order), initial=sum(whole)))
    out = [(array("q"), array("q"), array("q", bytes(8 * n))) for n in blocks]

    def window(s: int, j: int) -> tuple[int, int]:
        """Slots of block j: from the floor of its start to the ceiling of its end."""
        w, (releases, deadlines, _) = whole[s], out[s]
        if j == 0:
            releases.append(0)
        p = bisect_right(ends, ((j + 1) << shift) // w)
        slot, rest = divmod(flowing[p] * (j + 1), w)
        deadlines.append(given[p] + slot + (rest > 0))
        if j + 1 < blocks[s]:
            releases.append(given[p] + slot)
        return releases[j], deadlines[j]

    waiting: list[tuple[int, int, int, int]] = []
    ready: list[tuple[int, int, int]] = []
    for s, n in enumerate(blocks):
        if n:
            release, deadline = window(s, 0)
            heapq.heappush(waiting, (release, s, 0, deadline))
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j, deadline = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j))
        _, s, j = heapq.heappop(ready)
        out[s][2][j] = slot
        if j + 1 < blocks[s]:
            release, deadline = window(s, j + 1)
            heapq.heappush(waiting, (release, s, j + 1, deadline))
    return out


def _schedule_table(names: list[str], placed: list[tuple[array, array, array]]) -> pa.Table:
    """Rows (_source, _run, _releases, _deadlines, _slots), one for ``RUN_BLOCKS`` blocks of a source."""
    at = [(s, k) for s, windows in enumerate(placed) for k in range(0, len(windows[2]), RUN_BLOCKS)]
    lists = [pa.array([placed[s][c][k : k + RUN_BLOCKS] for s, k in at], pa.list_(pa.int64())) for c in range(3)]
    return pa.table([pa.array([names[s] for s, _ in at], pa.string()), pa.array([k // RUN_BLOCKS for _, k in at], pa.int64()), *lists], ["_source", "_run", "_releases", "_deadlines", "_slots"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.7, block_bytes: int | None = None, size: Column | None = None) -> DataFrame:
    """(doc, block, place, release, deadline, slot): every row of ``docs`` as a struct, with its place; (slot, place) is the order.

    ``weights`` are target shares of bytes by source; without them a source's share is its bytes to the
    power ``exponent`` (``size`` is the column of a row's bytes, else its text's, null as empty, plus
    one), and a source that ``weights`` leaves out weighs as the smallest given. A null source counts
    as the empty name. Repeated rows, null ids and columns of any name are kept; rows of equal id
    follow one another in any order. ``docs`` must be stored (it is read more than once). The driver
    orders blocks; rows find theirs by a join. Release and deadline are the slots of the block's
    window. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("source"), F.lit(""))
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1 if size is None else size).cast("long")
    sizes = docs.groupBy(name.alias("s")).agg(F.sum(size).alias("bytes"))
    found = sizes.toArrow().sort_by("s")
    names, held = found["s"].to_pylist(), found["bytes"].to_pylist()
    if weights is None:
        share = [float(b) ** exponent for b in held]
    else:
        share = [weights.get(s, min(weights.values())) for s in names]
    total = sum(held)
    block_bytes = block_bytes or max(BLOCK_BYTES, -(-total // MOST_BLOCKS))
    table = _schedule_table(names, place_blocks([-(-n // block_bytes) for n in held], share))
    table = materialize(spark.createDataFrame(table), "schedule")
    # the row travels as one struct, so no name of its columns can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), name.alias("_source"), F.col("doc_id").alias("_id"), size.alias("_size"))
    ranked = running_sum(keyed, ["_source"], [F.xxhash64("_id"), F.col("_id")], F.col("_size"), "_before", tasks_for(spark, total))
    ranked = ranked.withColumn("block", F.expr(f"_before div {block_bytes}")).withColumn("place", F.expr(f"_before % {block_bytes}"))
    dealt = ranked.alias("d").join(table.alias("t"), F.expr(f"d._source = t._source AND d.block div {RUN_BLOCKS} = t._run"))
    of_block = lambda c: F.element_at(f"t.{c}", F.expr(f"CAST(d.block % {RUN_BLOCKS} AS INT) + 1"))
    return dealt.select("d.doc", "d.block", "d.place", of_block("_releases").alias("release"), of_block("_deadlines").alias("deadline"), of_block("_slots").alias("slot"))


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, unchanged, in the order of the mix: partitions and rows follow one another.

    Null, empty and very long texts, null sources, ties, repeated rows, clashing names and an empty
    table are as in ``mix``.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    ordered = mix(docs, weights).repartitionByRange(tasks_for(docs.sparkSession, size), "slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select("doc.*")
