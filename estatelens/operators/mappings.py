"""The mapping registry: bootstrap, state, validation, automatic mapping, blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = {"custom_field": "field", "group": "group", "user": "user"}


def bootstrap(found: DataFrame) -> DataFrame:
    """Unmapped rows, one per script, kind and entity: at the first place, with the last usage or type."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("family")]
    place = F.struct("line_no", "rule_ord", "pos")
    rows = found.where(F.col("family").isin(*KINDS)).select("script_id", kind.alias("kind"), F.col("entity").alias("server_id"), place.alias("place"), F.coalesce("usage", "attr").alias("usage"))
    return rows.groupBy("script_id", "kind", "server_id").agg(F.min("place.line_no").alias("first_line"), F.max_by("usage", "place").alias("usage"), F.lit("unmapped").alias("status"))


def mapping_state(events: DataFrame) -> DataFrame:
    """Latest-wins fold of map and skip events, in any order of arrival.

    A skip keeps the cloud id of the last map; notes keep their last value that is not null; a
    skipped user is to be removed.
    """
    op, seq = F.col("op"), F.col("seq")
    last_map = F.max_by(F.when(op == "map", F.col("cloud_id")), F.when(op == "map", seq))
    status = F.when(F.max_by("op", "seq") == "map", "mapped").otherwise("skipped")
    out = events.groupBy("session_id", "kind", "server_id").agg(
        status.alias("status"), last_map.alias("cloud_id"), F.max_by(F.col("notes"), F.when(F.col("notes").isNotNull(), seq)).alias("notes"), F.max("seq").alias("seq"),
    )
    return out.withColumn("strategy", F.when((F.col("kind") == "user") & (F.col("status") == "skipped"), "remove"))


def resolve_ids(found: DataFrame, mappings: DataFrame) -> DataFrame:
    """Findings with their cloud id; unmapped ones stay."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("family")]
    return found.withColumn("kind", kind).join(mappings.select("kind", F.col("server_id").alias("entity"), "cloud_id", "status"), ["kind", "entity"], "left")


def validate(mappings: DataFrame, catalogue: DataFrame, as_of: str) -> DataFrame:
    """Mapped ids must be in the catalogue: found ones get name and time, others fall back to unmapped."""
    known = catalogue.select("cloud_id", F.col("name").alias("cloud_name"))
    joined = mappings.join(known, "cloud_id", "left")
    mapped, there = F.col("status") == "mapped", F.col("cloud_name").isNotNull()
    return joined.select(
        "session_id", "kind", "server_id", "cloud_id",
        F.when(mapped & ~there, "unmapped").otherwise(F.col("status")).alias("status"),
        F.when(mapped & there, F.col("cloud_name")).alias("cloud_name"),
        F.when(mapped & there, F.to_timestamp(F.lit(as_of))).alias("validated_at"),
        F.when(mapped & ~there, F.concat(F.lit("not in catalogue: "), "cloud_id")).otherwise(F.col("notes")).alias("notes"),
    )


#: Characters of a gram.
GRAM = 3


def _grams(c: str) -> Column:
    """The distinct grams of a text, and all shorter ones for the sake of shorter texts."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(n)))
    every = of(1)
    for n in range(2, GRAM + 1):
        every = F.array_union(every, of(n))
    return every


def _own_grams(c: str) -> Column:
    """The grams of full length, or the whole of a shorter text."""
    return F.when(F.length(c) <= GRAM, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.col(c).substr(i, F.lit(GRAM)))))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) of all distinct pairs of ``needles`` (needle) and ``texts`` (text) where the text holds the needle.

    An inverted index from grams to texts; a needle asks for the texts of the one of its grams that the
    fewest texts have, and only these are searched. A needle with a gram that no text has is held by
    none; the empty needle is held by all and is the caller's to treat.
    """
    held = texts.select("text").distinct().select("text", F.explode(_grams("text")).alias("gram"))
    asked = needles.where("needle <> ''").select("needle").distinct().select("needle", F.explode(_own_grams("needle")).alias("gram"))
    wide = held.join(asked.select("gram").distinct(), "gram", "left_semi")
    numbers = wide.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(numbers, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).where("best.n > 0").select("needle", "best.gram")
    return rarest.join(wide, "gram").where(F.contains("text", "needle")).select("needle", "text")


def auto_map(names: DataFrame, catalogue: DataFrame, prefix: str) -> DataFrame:
    """(server_id, server_name) to catalogue ids: equal normalised name, else one holding the other.

    Exact matches are an equi-join; names without one meet the catalogue by ``containing``, in both
    directions. Equal names, on either side, are looked up once. The first match in catalogue order
    (``ord``) counts. A blank name is held by every name of the catalogue, a blank entry of it by every name.
    """
    low = lambda c: F.lower(F.trim(c))
    cat = catalogue.where(F.col("cloud_id").startswith(prefix)).select("ord", "cloud_id", F.col("name").alias("cloud_name"), low("name").alias("key"))
    asked = names.select("server_id", "server_name", low("server_name").alias("key"))
    first = Window.partitionBy("key").orderBy("ord")
    exact = asked.join(cat.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn"), "key", "left")
    hit = exact.where("cloud_id IS NOT NULL").select("server_id", "server_name", "cloud_id", "cloud_name", F.lit("exact").alias("confidence"))
    rest = exact.where("cloud_id IS NULL").select("server_id", "server_name", "key")
    entry = F.min(F.struct("ord", "cloud_id", "cloud_name")).alias("entry")
    entries = cat.where("cloud_name IS NOT NULL").groupBy(F.lower("cloud_name").alias("ckey")).agg(entry)
    keys = rest.where("key IS NOT NULL").select("key").distinct()
    holds = containing(keys.select(F.col("key").alias("needle")), entries.select(F.col("ckey").alias("text"))).select(F.col("needle").alias("key"), F.col("text").alias("ckey"))
    held = containing(entries.select(F.col("ckey").alias("needle")), keys.select(F.col("key").alias("text"))).select(F.col("text").alias("key"), F.col("needle").alias("ckey"))
    near = holds.unionByName(held).join(entries, "ckey").select("key", "entry")
    every = entries.agg(F.min("entry").alias("entry"))  # one row: what a blank name gets
    blank = entries.where("ckey = ''").select("entry")  # at most one row: what every name gets
    near = near.unionByName(keys.where("key = ''").join(every).where("entry IS NOT NULL")).unionByName(keys.join(blank))
    best = near.groupBy("key").agg(F.min("entry").alias("b"))
    fuzzy = rest.join(best, "key", "left").select("server_id", "server_name", "b.cloud_id", "b.cloud_name", F.when(F.col("b.cloud_id").isNull(), "none").otherwise("fuzzy").alias("confidence"))
    return hit.unionByName(fuzzy)


def blockers(mappings: DataFrame) -> DataFrame:
    """Unmapped rows that keep a session from completion; a user's is an error if its risk is high."""
    risk = F.coalesce(F.col("risk"), F.lit("high")) if "risk" in mappings.columns else F.lit("high")
    severity = F.when((F.col("kind") == "user") & (risk != "high"), "warning").otherwise("error")
    return mappings.where("status = 'unmapped'").select("session_id", F.concat(F.lit("unmapped-"), "kind").alias("type"), F.col("server_id").alias("entity_id"), severity.alias("severity"))


def session_completion(mappings: DataFrame) -> DataFrame:
    """Every session with its number of blockers; complete iff there are none."""
    counts = blockers(mappings).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_blockers"))
    return mappings.select("session_id").distinct().join(counts, "session_id", "left").fillna(0, ["n_blockers"]).withColumn("is_complete", F.col("n_blockers") == 0)
