"""Classification of scripts by constant-pattern hit counts.

A script's words say which rules may match (``functions.rule_index``); what matches is folded to
one set of rule numbers a script, and scores are plain columns that count a rule list's members in it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rule_index import RuleIndex, distinct_lines, is_local, matches, may_cross, needed, sent
from ..functions.text import trimmed
from ..plans import rulepacks as packs
from ..sources.tables import kept

LANGUAGE_SCORES = {language: f"_language_{k}" for k, language in enumerate(packs.LANGUAGES)}
MODULE_SCORES = {module: f"_module_{k}" for k, module in enumerate(packs.MODULES)}
TRIGGER_SCORES = {trigger: f"_trigger_{k}" for k, trigger in enumerate(packs.TRIGGERS)}
ALL = ("language", "module", "trigger", "operation")


class Rule(NamedTuple):
    """A pattern with what it speaks for: a kind of score, a name, and a part of it."""

    kind: str
    name: str
    part: str
    pattern: str


RULES = (
    [Rule("language", language, part, p) for language, parts in packs.LANGUAGES.items() for part, patterns in parts.items() for p in patterns]
    + [Rule("module", module, "", p) for module, (_, patterns) in packs.MODULES.items() for p in patterns]
    + [Rule("trigger", trigger, "", p) for trigger, patterns in packs.TRIGGERS.items() for p in patterns]
    + [Rule("operation", "n_mappable", "", p) for p, _, _ in packs.MAPPABLE]
    + [Rule("operation", "n_unmappable", "", p) for p, _ in packs.UNMAPPABLE]
)

#: Rules from 0 on that look at the content without white space at its ends.
N_BODY = sum(rule.kind == "language" for rule in RULES)


def rule_index(kinds: tuple[str, ...] = ALL) -> RuleIndex:
    return RuleIndex([rule.pattern for rule in RULES if rule.kind in kinds])


def of_lines(lines: DataFrame, kinds: tuple[str, ...] = ALL) -> DataFrame:
    """(line, sure, maybe): numbers, in ``RULES``, of the rules that match every content with this line, and of those that its whole text decides.

    Languages look at the content without white space at its ends, so for them a line that begins or
    ends with some decides nothing. No row for lines that tell nothing.
    """
    numbers = [k for k, rule in enumerate(RULES) if rule.kind in kinds]
    index = rule_index(kinds)
    told = index.rules(lines, "number int, on_body boolean, is_local boolean, may_cross boolean", [(k, RULES[k].kind == "language", is_local(RULES[k].pattern), may_cross(RULES[k].pattern)) for k in numbers])
    line = F.col("line")
    may = index.candidates(lines, "line").distinct().join(told, "rule").withColumn("hit", matches(line))
    sure = F.col("hit") & F.col("is_local") & (~F.col("on_body") | (line == trimmed(line)))
    each = may.where("hit OR may_cross").select("line", "number", sure.alias("is_sure"))
    of = lambda wanted: F.collect_list(F.when(wanted, F.col("number")))
    return each.groupBy("line").agg(of(F.col("is_sure")).alias("sure"), of(~F.col("is_sure")).alias("maybe"))


def hits(scripts: DataFrame, kinds: tuple[str, ...] = ALL, lines: DataFrame | None = None) -> DataFrame:
    """Every script, without its content, with ``hits``: the numbers, in ``RULES``, of the rules of these kinds that match the content.

    What one line decides is asked once for each different line; expressions run on whole contents
    for the rest. ``lines`` are the stored different lines, where there are any already.
    """
    book = kept(of_lines(distinct_lines(scripts, "content") if lines is None else lines, kinds), "rules")
    each = scripts.select("script_id", F.explode(F.split("content", "\n", -1)).alias("line")).join(sent(book), "line")
    every = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    told = each.groupBy("script_id").agg(every("sure"), every("maybe")).withColumn("maybe", F.array_except("maybe", "sure"))
    body, patterns = trimmed(F.col("content")), F.array(*[F.lit(rule.pattern) for rule in RULES])
    text = lambda r: F.when(r < N_BODY, body).otherwise(F.col("content"))
    needs = F.array(*[F.array(*map(F.lit, needed(rule.pattern))).cast("array<string>") for rule in RULES])
    holds = lambda r: F.forall(F.element_at(needs, r + 1), lambda word: F.contains(F.col("content"), word))
    asked = F.filter("maybe", lambda r: holds(r) & F.rlike(text(r), F.element_at(patterns, r + 1)))
    found = F.when(F.size("maybe") > 0, F.concat("sure", asked)).otherwise(F.coalesce("sure", F.array().cast("array<int>")))
    return scripts.join(told, "script_id", "left").withColumn("hits", found).drop("content", "sure", "maybe")


#: What hits are counted for; a count takes ``BITS`` bits, and a 64-bit number holds ``EACH`` counts.
GROUPS = list(dict.fromkeys((rule.kind, rule.name, rule.part) for rule in RULES))
BITS, EACH = 6, 10


def packed() -> dict[str, Column]:
    """The counts of all groups from the column ``hits``, ``EACH`` to a column: each hit adds one at its group's bits."""
    out = {}
    for k in range(0, len(GROUPS), EACH):
        place = {group: 1 << BITS * j for j, group in enumerate(GROUPS[k : k + EACH])}
        ones = F.array(*[F.lit(place.get((rule.kind, rule.name, rule.part), 0)).cast("long") for rule in RULES])
        out[f"_counts_{k // EACH}"] = F.aggregate("hits", F.lit(0).cast("long"), _adding(ones))
    return out


def _adding(ones: Column):
    return lambda total, rule: total + F.element_at(ones, rule + 1)


def count(kind: str, name: str, part: str = "") -> Column:
    if (kind, name, part) not in GROUPS:
        return F.lit(0)
    k, j = divmod(GROUPS.index((kind, name, part)), EACH)
    return F.shiftright(f"_counts_{k}", BITS * j).bitwiseAND((1 << BITS) - 1).cast("int")


def _language_score(language: str) -> Column:
    sizes = {part: len(patterns) for part, patterns in packs.LANGUAGES[language].items()}
    # scores by number of hits, as tables: each number of hits is worked out once
    by_hits = lambda part, weight, base, step: F.element_at(F.array(*[F.lit(weight * min(1.0, base + h * step) if h else 0.0) for h in range(sizes[part] + 1)]), count("language", language, part) + 1)
    score = by_hits("syntax", 30.0, 0.4, 0.2) + by_hits("imports", 20.0, 0.0, 0.5) + by_hits("apis", 10.0, 0.0, 0.3) - 15.0 * count("language", language, "negative")
    own = F.regexp_extract("filename", r"(\.[^.]*)\z", 1).isin([e for e, lang in packs.EXTENSIONS.items() if lang == language])
    return F.round(F.greatest(F.lit(0.0), score) + F.when(own, 40.0).otherwise(0.0), 6)


def _module_score(module: str) -> Column:
    weight, patterns = packs.MODULES[module]
    table = [math.floor(weight * min(3.0, 1.0 + (h - 1) * 0.3) * 10 + 0.5 + 1e-9) / 10 if h else 0.0 for h in range(len(patterns) + 1)]
    return F.element_at(F.array(*map(F.lit, table)), count("module", module) + 1)


SCORES = {
    "language": lambda: {column: _language_score(language) for language, column in LANGUAGE_SCORES.items()},
    "module": lambda: {column: _module_score(module) for module, column in MODULE_SCORES.items()},
    "trigger": lambda: {column: count("trigger", trigger) for trigger, column in TRIGGER_SCORES.items()},
    "operation": lambda: {n: count("operation", n).cast("long") for n in ("n_mappable", "n_unmappable")},
}


def scored(scripts: DataFrame, *kinds: str, lines: DataFrame | None = None) -> DataFrame:
    """Every script, without its content, with the score columns of these kinds."""
    counted = hits(scripts, kinds or ALL, lines).withColumns(packed()).drop("hits")
    scores = counted.withColumns({name: column for kind in kinds or ALL for name, column in SCORES[kind]().items()})
    return scores.drop(*[c for c in scores.columns if c.startswith("_counts_")])


def _first_best(columns: dict[str, str]) -> Column:
    """The name whose column is largest, the first of equal ones; 'unknown' where none is above 0."""
    scores = list(columns.values())
    best = F.greatest(*scores)
    return F.when(best > 0, F.element_at(F.array(*map(F.lit, columns)), F.array_position(F.array(*scores), best).cast("int"))).otherwise("unknown")


def language_verdict() -> dict[str, Column]:
    """Columns language, language_confidence, language_score and language_margin from the score columns."""
    ranked = F.sort_array(F.array(*LANGUAGE_SCORES.values()), asc=False)
    top, margin = ranked[0], ranked[0] - ranked[1]
    known = top >= 5
    confidence = F.when(~known, "low").when((top >= 70) & (margin >= 20), "high").when((top >= 40) & (margin >= 10), "medium").otherwise("low")
    return {
        "language": F.when(known, _first_best(LANGUAGE_SCORES)).otherwise("unknown"), "language_confidence": confidence,
        "language_score": F.when(known, top).otherwise(0.0), "language_margin": margin,
    }


def _told(scores: DataFrame, names: dict[str, str], label: str) -> DataFrame:
    """A row per script and name."""
    rows = [F.struct(F.lit(k).alias("ord"), F.lit(name).alias(label), F.col(c).alias("score")) for k, (name, c) in enumerate(names.items(), 1)]
    return scores.select("script_id", F.explode(F.array(*rows)).alias("s")).select("script_id", "s.*")


def language_scores(scripts: DataFrame) -> DataFrame:
    """(script_id, ord, language, score), a row per script and language."""
    return _told(scored(scripts, "language"), LANGUAGE_SCORES, "language")


def classify_language(scripts: DataFrame) -> DataFrame:
    told = language_verdict()
    told.pop("language_margin")
    return scored(scripts, "language").select("script_id", *[c.alias(name) for name, c in told.items()])


def module_scores(scripts: DataFrame) -> DataFrame:
    return _told(scored(scripts, "module"), MODULE_SCORES, "module").where("score > 0")


def module_of() -> Column:
    return _first_best(MODULE_SCORES)


def trigger_of() -> Column:
    return _first_best(TRIGGER_SCORES)


def classify_module(scripts: DataFrame) -> DataFrame:
    return scored(scripts, "module", "trigger").select("script_id", module_of().alias("module"), trigger_of().alias("trigger"))


def metaprogramming(scripts: DataFrame) -> DataFrame:
    """Scripts with the strategy that their language and dynamic code ask for."""
    marked = scripts.withColumn("dynamic", F.col("content").rlike(packs.METAPROGRAMMING)).select("script_id", "filename", "content", "dynamic")
    flagged = scored(marked, "language").select("script_id", language_verdict()["language"].alias("language"), "dynamic")
    strategy = F.when(F.col("language") == "java", "static").when((F.col("language") == "groovy") & ~F.col("dynamic"), "static").when(F.col("language") == "groovy", "hybrid").otherwise("semantic")
    return flagged.withColumn("strategy", strategy)


def automation_operations(scripts: DataFrame) -> DataFrame:
    """First match of each operation pattern, mappable or not."""
    content = F.col("content")
    rows = [F.struct(F.lit(k).alias("ord"), F.lit(True).alias("mappable"), F.lit(label).alias("label"), F.regexp_extract(content, p, 0).alias("expression"), F.lit(equal).alias("equivalent")) for k, (p, label, equal) in enumerate(packs.MAPPABLE, 1)]
    rows += [F.struct(F.lit(100 + k).alias("ord"), F.lit(False).alias("mappable"), F.lit(label).alias("label"), F.regexp_extract(content, p, 0).alias("expression"), F.lit(None).cast("string").alias("equivalent")) for k, (p, label) in enumerate(packs.UNMAPPABLE, 1)]
    return scripts.select("script_id", F.explode(F.array(*rows)).alias("o")).select("script_id", "o.*").where("expression <> ''")
