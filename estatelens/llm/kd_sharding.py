"""K-d tree sharding: shards of nearly equal bytes, split at distributed weighted medians.

The metadata of a document are points in a space of four dimensions: size, language, source
and id. The tree starts with all documents and splits a node across its widest dimension (its
extent there over the root's extent) at the weighted median of bytes, until a leaf is one
shard. A node of k shards splits at floor(k/2)/k of its bytes.

One rule holds for groups of equal text at every size. A group stands where the smallest of
each of its metadata values puts it, and ties of a dimension are ordered by text hash. It is
dealt to pieces no heavier than the tolerance of a split (or than one of its texts), which lie
side by side in every order. So a group lighter than the tolerance is never cut, and a heavier
one only where a median falls inside it.

A weighted median is found by counting: bytes are summed in ``RANGES`` ranges of the ordering
key, the range that holds the median is cut again, until it weighs no more than the tolerance
or is one key. All nodes of a level are searched together. What a node is looking for stands
in a table of one row a node, as many as there are shards at most, which is joined to the
points; the driver sees no sums and builds no plan that grows with the number of shards. All
steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gapless_rank, materialize, tasks_for

RANGES = 4096
#: Share of a shard's bytes that a split may weigh more or less than the median asks for, both ways together.
TOLERANCE = 1 / 512
#: Bits of a dimension, of the text hash and of the piece in an ordering key.
DIMENSION_BITS, HASH_BITS, PIECE_BITS = 20, 23, 20
SPAN = 2**DIMENSION_BITS - 1
DIMENSIONS = ("by_size", "by_lang", "by_source", "by_id")


def kd_shards(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text, lang, source, ...).

    With ``target_bytes`` the number of shards is the least that keeps the mean leaf within it.
    A null text counts as the empty text (size 1, crc 0), a text of any length is one point; null
    metadata is a value like another; ties of a dimension go by text hash; repeated rows and null
    ids are kept as rows of their own. Slots number the rows of a shard without gaps from 0.
    Shards may stay empty where there are fewer pieces than shards. Other columns, whatever their
    names, are dropped. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce(F.crc32(F.col("lang").cast("binary")), F.lit(0)).alias("lang_key"),
        F.coalesce(F.crc32(F.col("source").cast("binary")), F.lit(0)).alias("source_key"),
    )
    meta = materialize(meta, "metadata")
    total, first, last = meta.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id")).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
    limit = max(1, int((total or 0) / shards * TOLERANCE))

    groups = meta.groupBy("text_key", "size").agg(
        F.count(F.lit(1)).alias("n"), F.min("lang_key").alias("lang_key"), F.min("source_key").alias("source_key"), F.min("doc_id").alias("least_id")
    )
    groups = materialize(groups, "groups")
    pieces = F.least(F.col("n"), F.ceil(F.col("n") * F.col("size") / F.lit(limit)), F.lit(2**PIECE_BITS)).cast("long")
    heavy = materialize(groups.where((F.col("n") > 1) & (F.col("n") * F.col("size") > limit)).select("text_key", "size", pieces.alias("pieces")), "heavy")
    # no hint: heavy groups are few as a rule, and Spark sends them to all tasks only when their table is small
    rows = meta.join(heavy, ["text_key", "size"], "left").select(
        "doc_id", "size", "text_crc32", "text_key", F.pmod(F.xxhash64("doc_id", "lang_key", "source_key"), F.coalesce("pieces", F.lit(1))).alias("piece")
    )
    scaled_id = F.floor((F.col("least_id") - F.lit(first)) / F.lit(max(1, last - first)) * SPAN) if first is not None else F.lit(0)
    cut = 32 - DIMENSION_BITS
    points = rows.groupBy("text_key", "size", "piece").agg(F.sum("size").alias("bytes")).join(groups.drop("n"), ["text_key", "size"]).select(
        "text_key", "size", "piece", "bytes",
        F.least(F.floor(F.log2(F.col("size").cast("double")) * 2 ** (DIMENSION_BITS - 6)), F.lit(SPAN)).cast("long").alias("by_size"),
        F.shiftright("lang_key", cut).alias("by_lang"),
        F.shiftright("source_key", cut).alias("by_source"),
        F.coalesce(scaled_id.cast("long"), F.lit(0)).alias("by_id"),
        (F.pmod(F.xxhash64("text_key"), F.lit(2**HASH_BITS)) * 2**PIECE_BITS + F.col("piece")).alias("tie"),
    )
    placed = grown(materialize(points, "points"), shards, limit).select("text_key", "size", "piece", "shard")
    rows = rows.join(placed, ["text_key", "size", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    rows = materialize(rows, "placed")
    n = rows.count()
    return gapless_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", tasks_for(docs.sparkSession, 40 * n))


def grown(points: DataFrame, shards: int, limit: int) -> DataFrame:
    """``points`` (bytes, by_size, by_lang, by_source, by_id, tie, any others) with their shard. All nodes of a level are split together."""
    extents = [f(c).alias(f"{c}_{f.__name__}") for c in DIMENSIONS for f in (F.min, F.max)]
    root = points.agg(*extents).first()
    span = {d: (root[f"{d}_max"] or 0) - (root[f"{d}_min"] or 0) for d in DIMENSIONS}
    share = F.array(*[(F.col(f"{d}_max") - F.col(f"{d}_min")) / F.lit(float(span[d] or 1)) for d in DIMENSIONS])
    # a node is named by its first shard and knows its number of shards
    points = points.withColumns({"shard": F.lit(0).cast("int"), "k": F.lit(shards).cast("int")})
    for _ in range((shards - 1).bit_length()):
        nodes = points.where("k > 1").groupBy("shard", "k").agg(F.sum("bytes").alias("weight"), *extents).withColumn("dim", F.array_position(share, F.array_max(share)).cast("int"))
        low, high = (F.element_at(F.array(*[F.col(f"{d}_{end}") for d in DIMENSIONS]), F.col("dim")) for end in ("min", "max"))
        base = 2 ** (HASH_BITS + PIECE_BITS)
        nodes = nodes.select(
            "shard", "dim", (low * base).alias("low"), (high * base + (base - 1)).alias("high"), F.lit(0).cast("long").alias("below"),
            (F.expr("k div 2") / F.col("k") * F.col("weight")).alias("wanted"), F.lit(None).cast("long").alias("cut"),
        )
        nodes = materialize(nodes, "nodes")
        # one row a node, ``shards`` rows at most: small enough for every task
        keyed = points.join(F.broadcast(nodes.select(F.col("shard").alias("node"), "dim")), F.col("shard") == F.col("node"))
        keyed = keyed.select("node", "bytes", (F.element_at(F.array(*DIMENSIONS), F.col("dim")) * base + F.col("tie")).alias("key"))
        cuts = weighted_quantiles(keyed, nodes.drop("dim"), limit).join(nodes.select("shard", "dim"), "shard")
        cuts = cuts.select(F.col("shard").alias("node"), "dim", "cut")
        half = F.expr("CAST(k div 2 AS INT)")
        key = F.element_at(F.array(*DIMENSIONS), F.col("dim")) * base + F.col("tie")
        above = F.coalesce(key > F.col("cut"), F.lit(False))
        names = [c for c in points.columns if c not in ("shard", "k")]
        told = points.join(F.broadcast(cuts), F.col("shard") == F.col("node"), "left")
        points = materialize(told.select(*names, F.when(above, F.col("shard") + half).otherwise(F.col("shard")).alias("shard"), F.when(F.col("k") <= 1, F.col("k")).when(above, F.col("k") - half).otherwise(half).alias("k")), "points")
    return points.drop("k")


def weighted_quantiles(keyed: DataFrame, search: DataFrame, limit: int) -> DataFrame:
    """(shard, cut): for each row of ``search`` (shard, low, high, below, wanted, cut) the key up to which ``wanted`` bytes of its node lie.

    ``keyed`` has (node, bytes, key). Off by half of ``limit`` at most, or by half of the bytes of
    one key. A node's keys lie between low and high; below is what weighs less than low.
    """
    done = search.where("cut IS NOT NULL").select("shard", "cut")
    while not search.isEmpty():
        step = search.withColumn("step", F.expr(f"(high - low) div {RANGES} + 1"))
        within = keyed.join(F.broadcast(step), (F.col("node") == F.col("shard")) & F.col("key").between(F.col("low"), F.col("high")))
        sums = within.groupBy("shard", "low", "high", "below", "wanted", "step", F.expr("(key - low) div step").alias("range")).agg(F.sum("bytes").alias("bytes"))
        upto = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # RANGES rows a node at most
        reached = sums.withColumn("upto", F.col("below") + F.sum("bytes").over(upto))
        last = Window.partitionBy("shard").orderBy(F.col("hit").desc(), F.when(F.col("hit"), F.col("range")).otherwise(-F.col("range")))
        found = reached.withColumn("hit", F.col("upto") >= F.col("wanted")).withColumn("rn", F.row_number().over(last)).where("rn = 1")
        start = F.col("low") + F.col("range") * F.col("step")
        end = F.least(F.col("high"), start + F.col("step") - 1)
        under = F.col("upto") - F.col("bytes")
        nearest = F.when(F.col("upto") - F.col("wanted") <= F.col("wanted") - under, end).otherwise(start - 1)
        cut = F.when((F.col("step") == 1) | (F.col("bytes") <= limit), nearest)
        search = materialize(found.select("shard", start.alias("low"), end.alias("high"), under.alias("below"), "wanted", cut.alias("cut")), "search")
        done = done.unionByName(search.where("cut IS NOT NULL").select("shard", "cut"))
        search = search.where("cut IS NULL")
    return done
