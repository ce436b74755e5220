"""Rule-pack matching: scripts to lines to findings, one scan for all families.

Rules meet the different lines by the words that both hold (``functions.rule_index``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rule_index import RuleIndex, distinct_lines, sent
from ..plans import rulepacks as packs
from ..sources.tables import kept


def explode_lines(scripts: DataFrame, key: str = "script_id") -> DataFrame:
    lines = scripts.select(key, F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    return lines.select(key, (F.col("at") + 1).alias("line_no"), "line")


def rule_index(families: list[str] | None = None) -> RuleIndex:
    return RuleIndex([pattern for f in families or packs.FAMILIES for pattern, _, _ in packs.FAMILIES[f]])


def candidates(lines: DataFrame, families: list[str] | None = None) -> DataFrame:
    """(line, family, rule_ord, pattern, grp, attr): lines with the rules that may match, by the words that they hold."""
    rules = [(f, k, *rule) for f in families or packs.FAMILIES for k, rule in enumerate(packs.FAMILIES[f], 1)]
    index = rule_index(families)
    told = index.rules(lines, "family string, rule_ord int, grp int, attr string", [(f, k, group, attr) for f, k, _, group, attr in rules])
    return index.candidates(lines, "line").distinct().join(told, "rule").drop("rule", "plain")


def of_lines(lines: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Every finding of each line of ``lines`` (line), once."""
    line = F.col("line")
    both = F.arrays_zip(F.regexp_extract_all(line, F.col("pattern"), F.lit(0)).alias("raw"), F.regexp_extract_all(line, F.col("pattern"), F.col("grp")).alias("entity"))
    found = candidates(lines, families).select("line", "family", "rule_ord", "attr", F.posexplode(both).alias("pos", "h")).select("*", "h.raw", "h.entity")
    http = F.col("family") == "http"
    local = F.col("entity").rlike("(?i)/rest/api/") | F.col("entity").rlike(r"localhost|127\.0\.0\.1")
    found = found.where(~(http & local))
    usage = F.when(line.rlike(packs.FIELD_WRITE), "write").when(line.rlike(packs.FIELD_READ), "read").when(line.rlike(packs.FIELD_SEARCH), "search").otherwise("unknown")
    method = F.upper(F.regexp_extract(line, packs.HTTP_METHOD, 1))
    url = F.col("entity")
    return found.select(
        "line", "family", "rule_ord", "pos",
        F.when(F.col("family").isin("http", "script_dep"), F.regexp_replace("raw", r"^\s+|\s+\z", "")).otherwise(F.col("raw")).alias("raw"),
        F.when(F.col("family") == "internal_api", F.concat(F.lit("/rest/api/"), F.col("attr"), F.lit("/"), url)).otherwise(url).alias("entity"),
        "attr",
        F.when(F.col("family") == "custom_field", usage).alias("usage"),
        F.when(http, F.col("attr")).when((F.col("family") == "internal_api") & (method != ""), method).when(F.col("family") == "internal_api", "unknown").alias("method"),
        F.when(http, url.contains("${") | url.contains("+") | url.rlike(r"\$\w+")).alias("dynamic"),
    )


def scan(scripts: DataFrame, families: list[str] | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Every finding once, with its order columns (script_id, line_no, family, rule_ord, pos); overlaps are kept.

    Expressions run once for each different line; scripts meet what was found by their lines.
    ``lines`` are the stored different lines of the scripts, where there are any already.
    """
    book = kept(of_lines(distinct_lines(scripts, "content") if lines is None else lines, families), "findings")
    told = explode_lines(scripts).join(sent(book), "line")
    return told.select("script_id", "line_no", *[c for c in book.columns if c != "line"])


def dedupe_first(found: DataFrame) -> DataFrame:
    """Per script, family and raw expression the first finding."""
    first = Window.partitionBy("script_id", "family", "raw").orderBy("line_no", "rule_ord", "pos")
    return found.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def findings(scripts: DataFrame, families: list[str] | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Per script, family and raw expression the first finding; ``lines`` as for ``scan``."""
    return dedupe_first(scan(scripts, families, lines))


def deprecated_uses(found: DataFrame) -> DataFrame:
    """Findings of deprecated APIs with class, reason and what takes the class's place (a join with the 33 definitions)."""
    uses = found.where("family = 'deprecated'").select("script_id", "line_no", "raw", F.split_part("attr", F.lit("|"), F.lit(1)).alias("api_class"), F.split_part("attr", F.lit("|"), F.lit(2)).alias("reason"))
    told = found.sparkSession.createDataFrame(list(packs.ALTERNATIVES.items()), "api_class string, alternative string")
    return uses.join(F.broadcast(told), "api_class").select("script_id", "line_no", "raw", "api_class", "reason", "alternative")


def merge_sources(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Findings of two sources: the primary wins per entity; the other adds fields, groups and users only."""
    more = other.where(F.col("family").isin("custom_field", "group", "user")).join(primary.select("script_id", "family", "entity").distinct(), ["script_id", "family", "entity"], "left_anti")
    return primary.unionByName(more)


def script_edges(found: DataFrame, scripts: DataFrame) -> DataFrame:
    """Imports with the script that they name, by file name; null where there is none."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/]+)\z", 1))
    named = scripts.groupBy(base("filename").alias("base")).agg(F.min("script_id").alias("target_script_id"))
    deps = found.where("family = 'script_dep'").select(F.col("script_id").alias("src_script_id"), F.col("entity").alias("imported_path"), F.col("attr").alias("import_type"), base("entity").alias("base"))
    return deps.join(named, "base", "left").drop("base")


def blocking_entities(found: DataFrame) -> DataFrame:
    """Fields, groups and users by the number of scripts that they hold up."""
    return found.where(F.col("family").isin("custom_field", "group", "user")).groupBy("family", "entity").agg(F.countDistinct("script_id").alias("n_scripts"))


def dynamic_regions(scripts: DataFrame, radius: int = 2, most: int = 5) -> DataFrame:
    """Windows of lines around dynamic code: after a hit, the next one counts only past the window."""
    hits = explode_lines(scripts).where(F.col("line").rlike(packs.METAPROGRAMMING)).groupBy("script_id").agg(F.sort_array(F.collect_list("line_no")).alias("hits"))
    chosen = F.aggregate("hits", F.array().cast("array<int>"), lambda kept, x: F.when((F.size(kept) == 0) | (x > F.element_at(kept, -1) + radius), F.array_append(kept, x)).otherwise(kept))
    at = hits.select("script_id", F.posexplode(F.slice(chosen, 1, most)).alias("region", "hit"))
    own = at.alias("r").join(explode_lines(scripts).alias("l"), F.expr(f"r.script_id = l.script_id AND l.line_no BETWEEN r.hit - {radius} AND r.hit + {radius}"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l.line_no", "l.line"))), lambda x: x["line"]), "\n")
    return own.groupBy("r.script_id", "r.region").agg(F.min("l.line_no").alias("first_line"), F.max("l.line_no").alias("last_line"), text.alias("content"))
