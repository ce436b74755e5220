"""Workflow exports: XML to scripts, with their place and what could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import slug, trimmed
from ..plans import rulepacks as packs


def functions(exports: DataFrame) -> DataFrame:
    """One row per function of each transition, in document order."""
    actions = F.regexp_extract_all("xml", F.lit(r"(?is)<action\b[^>]*>.*?</action>"), F.lit(0))
    name = F.regexp_extract("xml", r'(?i)<workflow\s+name="([^"]+)"', 1)
    rows = exports.select("workflow_id", F.when(name != "", name).otherwise("Unknown Workflow").alias("workflow_name"), F.posexplode(actions).alias("action_pos", "action"))
    status = lambda tag, attr: F.regexp_extract("action", rf'(?is)<{tag}\b[^>]*?\s{attr}="([^"]*)"', 1)
    either = lambda attr: F.coalesce(F.nullif(status("unconditional-result", attr), F.lit("")), F.nullif(status("result", attr), F.lit("")))
    parts = F.regexp_extract_all("action", F.lit(r'(?is)<function\b[^>]*>.*?</function>'), F.lit(0))
    rows = rows.select("workflow_id", "workflow_name", "action_pos", F.regexp_extract("action", r'(?i)<action\b[^>]*?\sname="([^"]*)"', 1).alias("transition"), either("old-status").alias("from_status"), either("status").alias("to_status"), F.posexplode(parts).alias("function_pos", "function"))
    return rows.withColumn("type", F.regexp_extract("function", r'(?i)<function\b[^>]*?\stype="([^"]*)"', 1))


# Named entities in the order in which they are decoded, the ampersand first.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]


def decoded(text: Column) -> Column:
    """Named entities, then decimal ones, each of these once; of a decimal one the lowest 16 bits count."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    # texts between the numbers, and the numbers: what one of them gives is not read again
    parts = F.split(text, r"&#\d+;", -1)
    numbers = F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1))
    code = lambda n: F.pmod(F.substring(n, -18, 18).cast("long"), F.lit(65536))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(code(n)), 4, "0")), "UTF-16BE")
    both = F.transform(F.arrays_zip(parts.alias("p"), numbers.alias("n")), lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.when(x["n"].isNotNull(), char(x["n"])).otherwise("")))
    return F.array_join(both, "")


def _argument(name: str) -> Column:
    """Text of an argument, trimmed and decoded: its CDATA, else its plain text; null if absent or blank."""
    tag = rf'(?is)<arg\s+name="{name.replace(".", chr(92) + ".")}"[^>]*>'
    cdata = F.regexp_extract_all("function", F.lit(rf"{tag}\s*<!\[CDATA\[(.*?)\]\]>\s*</arg>"), F.lit(1))
    plain = F.regexp_extract("function", rf"{tag}(.*?)</arg>", 1)
    found = decoded(trimmed(F.coalesce(F.get(cdata, F.lit(0)), plain)))
    return F.when(trimmed(found) != "", found)


def _script() -> Column:
    by_type = F
    for type_, (_, _, names) in packs.WORKFLOW_TYPES.items():
        by_type = by_type.when(F.col("type") == type_, F.coalesce(*[_argument(n) for n in names]))
    return by_type.otherwise(None)


def scripts(exports: DataFrame) -> DataFrame:
    """Scripts of known function types with module, language, index in the transition and total."""
    module, language = F, F
    for type_, (mod, lang, _) in packs.WORKFLOW_TYPES.items():
        module, language = module.when(F.col("type") == type_, mod), language.when(F.col("type") == type_, lang)
    found = functions(exports).select("*", _script().alias("script"), module.otherwise(None).alias("module"), language.otherwise(None).alias("language")).where("script IS NOT NULL")
    place = Window.partitionBy("workflow_id", "action_pos").orderBy("function_pos")
    found = found.withColumn("script_index", F.row_number().over(place) - 1).withColumn("total_scripts", F.count(F.lit(1)).over(Window.partitionBy("workflow_id")))
    name = F.concat_ws("-", slug(F.col("workflow_name")), slug(F.col("transition")), "module", F.col("script_index").cast("string"))
    return found.withColumn("filename", F.concat(name, F.when(F.col("language") == "sil", ".sil").otherwise(".groovy"))).drop("function")


def warnings(exports: DataFrame) -> DataFrame:
    """(workflow_id, warning, detail): no actions, unknown script types, outside files, no scripts at all."""
    f = functions(exports)
    known = F.col("type").isin(*packs.WORKFLOW_TYPES)
    unknown = f.where(~known & F.lower("type").rlike("groovy|script|sil")).select("workflow_id", F.lit("unknown-type").alias("warning"), F.col("type").alias("detail"))
    outside = f.withColumn("file", F.coalesce(_argument("FIELD_FUNCTION_ID"), _argument("script.file"))).where(known & _script().isNull() & F.col("file").isNotNull())
    outside = outside.select("workflow_id", F.lit("external-file").alias("warning"), F.col("file").alias("detail"))
    none = exports.where(~F.col("xml").rlike(r"(?is)<action\b[^>]*>.*?</action>")).select("workflow_id", F.lit("no-actions").alias("warning"), F.lit(None).cast("string").alias("detail"))
    told = unknown.unionByName(outside).unionByName(none)
    silent = exports.select("workflow_id").join(scripts(exports).select("workflow_id"), "workflow_id", "left_anti").join(told.select("workflow_id"), "workflow_id", "left_anti")
    return told.unionByName(silent.select("workflow_id", F.lit("no-scripts").alias("warning"), F.lit(None).cast("string").alias("detail")))
