"""Readiness: counts, issues, score, level, target, effort, suitability, portfolio.

Everything of a script is keyed by ``script_id``; the profile is computed once and carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rule_index import distinct_lines
from ..functions.text import lines_of_code
from ..plans import rulepacks as packs
from . import classify
from .findings import findings


def reason_column(reason: str) -> str:
    return "r_" + reason.replace("-", "_")


def category_column(category: str) -> str:
    return "c_" + category.replace("-", "_")


def dependency_counts(found: DataFrame, evidence: bool = False) -> DataFrame:
    """A row per script that has findings: numbers by family, by reason, and of special kinds; the findings themselves in order if asked for."""
    family, attr, entity = F.col("family"), F.col("attr"), F.col("entity")
    reason = F.element_at(F.split("attr", r"\|"), -1)
    counts = [F.count_if(family == f).alias(f"n_{f}") for f in packs.FAMILIES]
    counts += [F.count_if((family == "deprecated") & (reason == r)).alias(reason_column(r)) for r in packs.REASONS]
    api = family == "internal_api"
    counts += [
        F.count_if(api & (attr == "2")).alias("n_v2"), F.count_if(api & (attr == "3")).alias("n_v3"),
        F.count_if((family == "http") & F.coalesce(F.col("dynamic"), F.lit(False))).alias("n_dynamic"),
        F.count_if((family == "user") & F.col("raw").contains("runAs")).alias("n_run_as"),
        F.count_if(api & entity.rlike("search|picker")).alias("n_search_or_picker"),
        F.count_if(api & entity.contains("search")).alias("n_search"),
    ]
    if evidence:
        shown = F.struct("line_no", "rule_ord", "pos", "family", "attr", F.coalesce("dynamic", F.lit(False)).alias("dynamic"), "raw", "entity", F.substring_index("attr", "|", 1).alias("class"))
        counts.append(F.array_sort(F.collect_list(shown)).alias("evidence"))
    return found.groupBy("script_id").agg(*counts)


def profile(scripts: DataFrame, evidence: bool = False) -> DataFrame:
    """One row per script: counts, lines of code, language, module, trigger, operations, complexity.

    Rules are asked of the different lines of all scripts; what moves by script are findings, hit rules and lines of code.
    """
    lines = distinct_lines(scripts, "content")
    counts = dependency_counts(findings(scripts, lines=lines), evidence)
    zero = {c: 0 for c in counts.columns if c not in ("script_id", "evidence")}
    sized = scripts.select("script_id", "filename", "content", lines_of_code(F.col("content")).alias("loc"))
    base = classify.scored(sized, lines=lines).select("script_id", "loc", classify.module_of().alias("module"), classify.trigger_of().alias("trigger"), "n_mappable", "n_unmappable", *[c.alias(n) for n, c in classify.language_verdict().items()])
    out = base.join(counts, "script_id", "left").fillna(zero)
    points = F.floor(F.col("loc") / 50)
    for f, weight in packs.COMPLEXITY.items():
        points = points + weight * F.col(f"n_{f}")
    level = F
    for least, name in packs.COMPLEXITY_LEVELS:
        level = level.when(points >= least, name)
    return out.withColumn("complexity_points", points.cast("long")).withColumn("complexity", level.otherwise("low"))


def issue_list(evidence: bool = False) -> Column:
    """The issues of a profile row, as an array; with evidence each has the first line and the expressions it is about."""

    def issue(code: str, level: str, category: str, needs: bool) -> Column:
        parts = [F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(needs).alias("needs_mapping")]
        return F.struct(*parts, *(_shown(packs.EVIDENCE[code]) if evidence else []))

    rules = [F.when(F.expr(cond), issue(code, level, category, needs)) for code, level, category, needs, cond in packs.READINESS]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def _shown(rule: str | tuple) -> list[Column]:
    if isinstance(rule, str):
        return [F.lit(None).cast("int").alias("first_line"), F.lit(rule).alias("affected")]
    condition, field, most, otherwise = rule
    own = F.expr(f"filter(evidence, e -> {condition.format(f='e.')})")
    told = F.array_join(F.transform(F.slice(own, 1, most), lambda e: e[field]), ", ")
    return [F.get(own, F.lit(0))["line_no"].alias("first_line"), (told if otherwise is None else F.coalesce(F.nullif(told, F.lit("")), F.lit(otherwise))).alias("affected")]


def issues(profiles: DataFrame) -> DataFrame:
    """(script_id, code, level, category, needs_mapping), and first_line and affected where the profiles have evidence."""
    return profiles.select("script_id", F.explode(issue_list("evidence" in profiles.columns)).alias("i")).select("script_id", "i.*")


def confidences(profiles: DataFrame, coverage: float = 0.3) -> DataFrame:
    """How sure each detection is; ``coverage`` is the share of a SIL script that patterns read."""
    rounded = lambda c: F.floor(c * 100 + 0.5) / 100
    return profiles.select(
        "script_id",
        rounded(F.least(F.lit(1.0), F.col("language_score") / 80)).alias("language_detection"),
        F.when(F.col("module") != "unknown", 1.0).otherwise(0.0).alias("module_detection"),
        F.when(F.col("trigger") != "unknown", 1.0).otherwise(0.0).alias("trigger_detection"),
        F.when(F.col("language") == "sil", rounded(F.lit(0.6 + 0.4 * coverage))).otherwise(0.95).alias("dependency_extraction"),
        F.when(F.col("n_deprecated") > 5, 0.6).otherwise(0.85).alias("readiness_analysis"),
    )


def suitability(profiles: DataFrame) -> DataFrame:
    """Whether a script fits an automation rule: the first reason against it, in order."""
    mapped = F.create_map(*[F.lit(x) for kv in packs.AUTOMATION_TRIGGERS.items() for x in kv])[F.col("trigger")]
    steps = [
        ("mapped_trigger IS NULL", "no-trigger", "low"),
        ("r_server_only_java_api > 0 OR r_filesystem_access > 0 OR r_direct_sql > 0", "server-only", "low"),
        ("n_script_dep > 0", "script-dependencies", "low"),
        ("complexity IN ('high', 'critical')", "complexity", "low"),
        ("n_unmappable > 0", "unmappable-operations", "medium"),
        ("n_mappable = 0", "no-operations", "low"),
    ]
    step, confidence = F, F
    for cond, name, conf in steps:
        step, confidence = step.when(F.expr(cond), name), confidence.when(F.expr(cond), conf)
    fits = F.when(F.col("complexity") == "low", "high").otherwise("medium")
    out = profiles.withColumn("mapped_trigger", mapped)
    return out.withColumn("rationale", step.otherwise("suitable")).withColumn("confidence", confidence.otherwise(fits)).withColumn("suitable", F.col("rationale") == "suitable")


#: Columns of ``verdicts`` after script_id.
VERDICT = "language string, module string, trigger string, loc int, complexity string, n_issues long, score long, level string, target string, consultant_hours double, assisted_hours double, needs_users boolean, needs_fields boolean, has_http boolean"


def verdicts(scripts: DataFrame) -> DataFrame:
    """One row per script: score, level, target, complexity, hours. All from one profile row."""
    rows = suitability(profile(scripts)).withColumn("issues", issue_list())
    number = lambda level: F.size(F.filter("issues", lambda i: i["level"] == level))
    has = {category_column(c): F.exists("issues", _of_category(c)) for c in sorted({c for _, _, c, _, _ in packs.READINESS})}
    rows = rows.withColumns({"n_issues": F.size("issues").cast("long"), "n_red": number("red"), "n_yellow": number("yellow")} | has)
    level = F.when(F.col("n_red") > 0, "red").when(F.col("n_yellow") > 0, "yellow").otherwise("green")
    return rows.select(
        "script_id", "language", "module", "trigger", "loc", "complexity", "n_issues",
        F.greatest(F.lit(0), F.least(F.lit(100), 100 - 25 * F.col("n_red") - 10 * F.col("n_yellow"))).cast("long").alias("score"),
        level.alias("level"), target().alias("target"), hours(0).alias("consultant_hours"), hours(1).alias("assisted_hours"),
        (F.col("n_user") > 0).alias("needs_users"), (F.col("n_custom_field") > 0).alias("needs_fields"), (F.col("n_http") > 0).alias("has_http"),
    )


def _of_category(category: str):
    return lambda i: i["category"] == category


def target() -> Column:
    out = F
    for cond, name in packs.TARGETS:
        out = out.when(F.expr(cond), name)
    return out.otherwise("forge-native")


def hours(k: int) -> Column:
    out = F
    for name, pair in packs.EFFORT.items():
        out = out.when(F.col("complexity") == name, pair[k])
    return out


def portfolio(verdict: DataFrame) -> DataFrame:
    """Scripts, mean score and hours by language, module and level, with all sub-totals."""
    sums = [F.count(F.lit(1)).alias("n_scripts"), F.round(F.avg("score"), 6).alias("avg_score"), F.sum("consultant_hours").alias("consultant_hours"), F.sum("assisted_hours").alias("assisted_hours")]
    rolled = verdict.rollup("language", "module", "level").agg(F.grouping_id().alias("grouping"), *sums)
    return with_savings(rolled)


def with_savings(rolled: DataFrame) -> DataFrame:
    saved = F.floor((F.col("consultant_hours") - F.col("assisted_hours")) / F.col("consultant_hours") * 100 + 0.5)
    return rolled.withColumn("savings_percent", saved.cast("long"))


def workflow_override(verdict: DataFrame, scripts_of_workflows: DataFrame) -> DataFrame:
    """A script keeps its own module unless that is unknown or a field function; then the workflow's wins."""
    weak = F.col("module").isin("unknown", "field-function") & F.col("workflow_module").isNotNull()
    return verdict.join(scripts_of_workflows.select("script_id", "workflow_module"), "script_id", "left").withColumn("module", F.when(weak, F.col("workflow_module")).otherwise(F.col("module"))).drop("workflow_module")
