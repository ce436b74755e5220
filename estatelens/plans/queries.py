"""Registered queries: name -> function of (spark, sf_dir), and the SQL form of each that has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, findings, index, lint, mappings, memo, readiness, retrieval, runs, targets, telemetry, templates, workflow
from ..operators.chunker import cut_documents
from ..operators.vector_index import VectorIndex
from ..sources import io
from ..sources.estate import table
from ..sources.tables import kept, new_path
from . import oracles as o
from . import rulepacks as packs
from .params import AS_OF, CHUNK_TOKENS, OVERLAP_TOKENS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return put


# --- scripts

REJECT = r"""CASE WHEN lower(regexp_extract(filename, '(\.[^.]*)\z', 1)) NOT IN ('.groovy', '.java', '.sil', '.xml', '.txt') THEN 'unsupported-extension' WHEN strlen(content) > 2097152 THEN 'too-large'
 WHEN regexp_replace(content, '^\s+|\s+\z', '', 'g') = '' THEN 'PARSE_001' WHEN length(content) > 50000 THEN 'PARSE_002' END"""


@query(f"SELECT script_id, filename, reason, 'red' AS level, 0 AS score, 'manual-rewrite' AS target FROM (SELECT *, {REJECT} AS reason FROM ({o.duck('uploads')})) WHERE reason IS NOT NULL")
def script_rejects(spark, d):
    return io.split_rejects(table(spark, d, "uploads"))[1]


@query(f"""SELECT content_hash, count(*) AS n_scripts, min(script_id) AS first_script, max(loc) AS loc, max(tokens) AS tokens FROM
 (SELECT script_id, sha256(content) AS content_hash, {o.LOC} AS loc, CAST(ceil(length(content) / 4.0) AS INTEGER) AS tokens FROM ({o.duck('scripts')})) GROUP BY content_hash""")
def loc_and_fingerprint(spark, d):
    c = F.col("content")
    rows = table(spark, d, "scripts").select("script_id", tx.fingerprint(c).alias("content_hash"), tx.lines_of_code(c).alias("loc"), tx.token_estimate(c).alias("tokens"))
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_scripts"), F.min("script_id").alias("first_script"), F.max("loc").alias("loc"), F.max("tokens").alias("tokens"))


FOUND = ["script_id", "line_no", "rule_ord", "raw", "entity", "attr", "usage", "method", "dynamic"]


def _family(family, spark, d):
    return findings.findings(table(spark, d, "scripts"), [family]).select(*FOUND)


for _f in packs.FAMILIES:
    query(f"WITH {o.findings([_f])} SELECT {', '.join(FOUND)} FROM found", f"findings_{_f}")(partial(_family, _f))


VALUES = ", ".join(f"({o.q(c)}, {o.q(a)})" for c, a in packs.ALTERNATIVES.items())


@query(f"WITH {o.findings(['deprecated'])} SELECT script_id, line_no, raw, api_class, split_part(attr, '|', 2) AS reason, alternative FROM found JOIN (VALUES {VALUES}) t(api_class, alternative) ON api_class = split_part(attr, '|', 1)")
def deprecated_alternatives(spark, d):
    return findings.deprecated_uses(findings.findings(table(spark, d, "scripts"), ["deprecated"]))


@query(f"WITH {o.findings()} SELECT family, count(*) AS n, count(DISTINCT script_id) AS n_scripts, count(DISTINCT entity) AS n_entities FROM found GROUP BY family")
def findings_union(spark, d):
    found = findings.findings(table(spark, d, "scripts"))
    return found.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("script_id").alias("n_scripts"), F.count_distinct("entity").alias("n_entities"))


@query(f"WITH scripts AS ({o.duck('scripts')}) {o.language_rows()}")
def language_scores(spark, d):
    return classify.language_scores(table(spark, d, "scripts"))


@query(f"WITH scripts AS ({o.duck('scripts')}), {o.lang()} SELECT * FROM lang")
def language_verdict(spark, d):
    return classify.classify_language(table(spark, d, "scripts"))


@query(f"WITH scripts AS ({o.duck('scripts')}) SELECT * FROM ({o.module_rows()}) WHERE score > 0")
def module_scores(spark, d):
    return classify.module_scores(table(spark, d, "scripts"))


@query(f"WITH scripts AS ({o.duck('scripts')}), {o.module()} SELECT script_id, module, trigger FROM mods JOIN trigs USING (script_id)")
def trigger_scores(spark, d):
    return classify.classify_module(table(spark, d, "scripts"))


@query(f"""WITH scripts AS ({o.duck('scripts')}), {o.lang()}, flagged AS (SELECT script_id, regexp_matches(content, {o.q(packs.METAPROGRAMMING)}) AS dynamic FROM scripts)
 SELECT script_id, language, dynamic, CASE WHEN language = 'java' THEN 'static' WHEN language = 'groovy' AND NOT dynamic THEN 'static' WHEN language = 'groovy' THEN 'hybrid' ELSE 'semantic' END AS strategy FROM flagged JOIN lang USING (script_id)""")
def metaprogramming(spark, d):
    return classify.metaprogramming(table(spark, d, "scripts"))


@query(f"""WITH RECURSIVE scripts AS ({o.duck('scripts')}), lines AS {o.lines('SELECT * FROM scripts')}, hit AS (SELECT script_id, line_no FROM lines WHERE regexp_matches(line, {o.q(packs.METAPROGRAMMING)})),
 chosen AS (SELECT script_id, min(line_no) AS h, 0 AS region FROM hit GROUP BY script_id
 UNION ALL SELECT c.script_id, (SELECT min(line_no) FROM hit x WHERE x.script_id = c.script_id AND x.line_no > c.h + 2), c.region + 1 FROM chosen c
 WHERE c.region < 4 AND EXISTS (SELECT 1 FROM hit x WHERE x.script_id = c.script_id AND x.line_no > c.h + 2))
 SELECT c.script_id, region, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(line, chr(10) ORDER BY line_no) AS content FROM chosen c JOIN lines l ON l.script_id = c.script_id AND l.line_no BETWEEN h - 2 AND h + 2 GROUP BY c.script_id, region""")
def dynamic_regions(spark, d):
    return findings.dynamic_regions(table(spark, d, "scripts"))


@query(f"WITH scripts AS ({o.duck('scripts')}), {o.operations()} SELECT * FROM ops")
def automation_ops(spark, d):
    return classify.automation_operations(table(spark, d, "scripts"))


@query(f"WITH {o.suitability()} SELECT * FROM fit")
def automation_suitability(spark, d):
    fit = readiness.suitability(readiness.profile(table(spark, d, "scripts")))
    return fit.select("script_id", "suitable", "confidence", "rationale", "mapped_trigger", "n_mappable", "n_unmappable")


@query(f"WITH {o.findings()} SELECT script_id, {o.counts_select()} FROM found GROUP BY script_id")
def dependency_counts(spark, d):
    return readiness.dependency_counts(findings.findings(table(spark, d, "scripts")))


@query(f"WITH {o.profile()} SELECT script_id, loc, pts AS complexity_points, complexity FROM profile")
def complexity(spark, d):
    return readiness.profile(table(spark, d, "scripts")).select("script_id", "loc", "complexity_points", "complexity")


@query(f"WITH {o.shown_issues()} SELECT * FROM shown")
def readiness_issues(spark, d):
    return readiness.issues(readiness.profile(table(spark, d, "scripts"), evidence=True))


@query(f"""WITH {o.profile()} SELECT script_id, floor(least(1.0, language_score / 80) * 100 + 0.5) / 100 AS language_detection, CASE WHEN module <> 'unknown' THEN 1.0 ELSE 0.0 END AS module_detection, CASE WHEN trigger <> 'unknown' THEN 1.0 ELSE 0.0 END AS trigger_detection,
 CASE WHEN language = 'sil' THEN 0.72 ELSE 0.95 END AS dependency_extraction, CASE WHEN n_deprecated > 5 THEN 0.6 ELSE 0.85 END AS readiness_analysis FROM profile JOIN lang USING (script_id, language)""")
def detection_confidence(spark, d):
    return readiness.confidences(readiness.profile(table(spark, d, "scripts")))


@query(f"""WITH scripts AS ({o.duck('scripts')}), {o.module()}, own AS (SELECT action_id AS script_id, CASE WHEN type LIKE '%Validator' THEN 'validator' ELSE 'post-function' END AS workflow_module FROM ({o.duck('workflow_rows')}) WHERE type NOT LIKE '%GroovyUnknown')
 SELECT script_id, CASE WHEN module IN ('unknown', 'field-function') AND workflow_module IS NOT NULL THEN workflow_module ELSE module END AS module FROM mods LEFT JOIN own USING (script_id)""")
def workflow_override(spark, d):
    types = F.create_map(*[F.lit(x) for t, (module, _, _) in packs.WORKFLOW_TYPES.items() for x in (t, module)])
    own = table(spark, d, "workflow_rows").select(F.col("action_id").alias("script_id"), types[F.col("type")].alias("workflow_module"))
    return readiness.workflow_override(classify.classify_module(table(spark, d, "scripts")).drop("trigger"), own)


@query(f"WITH {o.verdicts()} SELECT * FROM verdicts")
def readiness_verdict(spark, d):
    return readiness.verdicts(table(spark, d, "scripts")).drop("needs_users", "needs_fields", "has_http")


@query(f"WITH {o.verdicts()} SELECT target, level, count(*) AS n_scripts, min(score) AS least_score FROM verdicts GROUP BY target, level")
def migration_target(spark, d):
    return readiness.verdicts(table(spark, d, "scripts")).groupBy("target", "level").agg(F.count(F.lit(1)).alias("n_scripts"), F.min("score").alias("least_score"))


@query(f"""WITH {o.verdicts()} SELECT *, CAST(floor((consultant_hours - assisted_hours) / consultant_hours * 100 + 0.5) AS BIGINT) AS savings_percent FROM
 (SELECT language, module, level, grouping(language, module, level) AS "grouping", {o.PORTFOLIO_SUMS} FROM verdicts GROUP BY ROLLUP (language, module, level))""")
def portfolio_rollup(spark, d):
    return readiness.portfolio(readiness.verdicts(table(spark, d, "scripts")))


@query(ORACLES["portfolio_rollup"].replace(o.duck("scripts"), o.duck("scripts_2")))
def portfolio_refresh(spark, d):
    """The portfolio of the estate's second version from that of the first: only contents that are new are scanned."""
    known = memo.Memo(new_path(spark, "profiles"))
    old, new = table(spark, d, "scripts"), table(spark, d, "scripts_2")
    return memo.portfolio(memo.changed_cells(kept(memo.cells(known.verdicts(old)), "cells"), known, old, new))


@query(f"WITH {o.findings(['custom_field', 'group', 'user'])} SELECT family, entity, count(DISTINCT script_id) AS n_scripts FROM found GROUP BY family, entity")
def blocking_entities(spark, d):
    return findings.blocking_entities(findings.findings(table(spark, d, "scripts"), ["custom_field", "group", "user"]))


@query(f"WITH {o.findings(['script_dep'])} SELECT script_id AS src_script_id, entity AS imported_path, attr AS import_type FROM found WHERE lower(regexp_extract(entity, '([^/]+)\\z', 1)) NOT IN (SELECT lower(filename) FROM scripts)")
def dangling_imports(spark, d):
    scripts = table(spark, d, "scripts")
    return findings.script_edges(findings.findings(scripts, ["script_dep"]), scripts).where("target_script_id IS NULL").select("src_script_id", "imported_path", "import_type")


@query(f"""WITH {o.findings(['custom_field', 'group', 'user'])}, other AS (SELECT script_id, family, entity FROM found WHERE script_id % 2 = 0), prim AS (SELECT script_id, family, entity FROM found WHERE rule_ord = 1)
 SELECT family, count(*) AS n FROM (SELECT * FROM prim UNION ALL SELECT * FROM other x WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.script_id = x.script_id AND p.family = x.family AND p.entity = x.entity)) GROUP BY family""")
def dep_merge(spark, d):
    found = findings.findings(table(spark, d, "scripts"), ["custom_field", "group", "user"])
    return findings.merge_sources(found.where("rule_ord = 1"), found.where("script_id % 2 = 0")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


# --- mappings

@query(f"""WITH {o.findings(['custom_field', 'group', 'user'])} SELECT script_id, CASE family WHEN 'custom_field' THEN 'field' ELSE family END AS kind, entity AS server_id, min(line_no) AS first_line,
 arg_max(coalesce(usage, attr), line_no * 10000 + rule_ord * 100 + pos) AS usage, 'unmapped' AS status FROM found GROUP BY script_id, family, entity""")
def mapping_bootstrap(spark, d):
    return mappings.bootstrap(findings.findings(table(spark, d, "scripts"), list(mappings.KINDS)))


@query(f"WITH {o.state()} SELECT * FROM state")
def mapping_state(spark, d):
    return mappings.mapping_state(table(spark, d, "mapping_events"))


@query(f"WITH {o.validated()} SELECT * FROM val")
def mapping_validation(spark, d):
    return mappings.validate(mappings.mapping_state(table(spark, d, "mapping_events")), table(spark, d, "catalogue"), AS_OF)


@query(f"WITH {o.validated()} SELECT session_id, concat('unmapped-', kind) AS type, server_id AS entity_id, 'error' AS severity FROM val WHERE status = 'unmapped'")
def completion_blockers(spark, d):
    return mappings.blockers(mapping_validation(spark, d))


@query(f"WITH {o.validated()} SELECT session_id, count(*) FILTER (WHERE status = 'unmapped') AS n_blockers, count(*) FILTER (WHERE status = 'unmapped') = 0 AS is_complete FROM val GROUP BY session_id")
def session_completion(spark, d):
    return mappings.session_completion(mapping_validation(spark, d))


CATALOGUE = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 1, 9) WHEN 2 THEN concat('The ', p_name, ' field') ELSE concat(p_name, ' ', p_brand) END"


@query(f"""WITH names AS (SELECT p_partkey AS server_id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN concat('Old ', p_name) ELSE substr(p_name, 2) END AS server_name FROM part), n AS (SELECT *, lower(trim(server_name)) AS key FROM names),
 cat AS (SELECT p_partkey AS ord, concat('customfield_', CAST(p_partkey AS VARCHAR)) AS cloud_id, {CATALOGUE} AS cloud_name FROM part), c AS (SELECT lower(cloud_name) AS ckey, lower(trim(cloud_name)) AS ekey, min(ord) AS ord FROM cat GROUP BY ALL), k AS (SELECT DISTINCT key FROM n),
 pairs AS (SELECT key, ord, CASE WHEN ekey = key THEN 1 ELSE 2 END AS pri FROM k JOIN c ON ekey = key OR contains(ckey, key) OR contains(key, ckey)),
 best AS (SELECT key, min({{'p': pri, 'o': ord}}) AS b FROM pairs GROUP BY key)
 SELECT n.server_id, n.server_name, cloud_id, cloud_name, CASE b.p WHEN 1 THEN 'exact' WHEN 2 THEN 'fuzzy' ELSE 'none' END AS confidence FROM n LEFT JOIN best USING (key) LEFT JOIN cat ON cat.ord = b.o""")
def auto_map(spark, d):
    part = table(spark, d, "part")
    names = part.selectExpr("p_partkey AS server_id", "CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN concat('Old ', p_name) ELSE substr(p_name, 2) END AS server_name")
    cat = part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("customfield_"), F.col("p_partkey").cast("string")).alias("cloud_id"), F.expr(CATALOGUE).alias("name"))
    return mappings.auto_map(names, cat, "customfield_")


@query(f"""WITH {o.state()} SELECT session_id, string_agg(concat(kind, '|', server_id, '|', coalesce(cloud_id, ''), '|', status), ';' ORDER BY kind, server_id) AS mappings, TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR AS expires_at FROM state GROUP BY session_id""")
def session_round_trip(spark, d):
    back, _ = io.import_sessions(io.export_sessions(mappings.mapping_state(table(spark, d, "mapping_events"))), AS_OF)
    row = F.concat_ws("|", "kind", "server_id", F.coalesce("cloud_id", F.lit("")), "status")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "server_id", row.alias("r")))), lambda x: x["r"]), ";")
    return back.groupBy("session_id", "expires_at").agg(told.alias("mappings"))


def _file_mappings(spark, d):
    """Mappings for the generated files: cloud ids by customer, some skipped."""
    cust = table(spark, d, "customer")
    fields = cust.select((F.col("c_custkey") % 900).alias("k")).distinct().where("k % 5 <> 0").select(F.lit("field").alias("kind"), F.concat(F.lit("customfield_"), (10000 + F.col("k")).cast("string")).alias("server_id"), F.when(F.col("k") % 7 != 0, F.concat(F.lit("customfield_9"), F.col("k").cast("string"))).alias("cloud_id"), F.when(F.col("k") % 7 == 0, "skipped").otherwise("mapped").alias("status"))
    users = cust.select((F.col("c_custkey") % 50).alias("k")).distinct().where("k % 4 <> 0").select(F.lit("user").alias("kind"), F.concat(F.lit("user"), F.col("k").cast("string")).alias("server_id"), F.concat(F.lit("acc-"), F.col("k").cast("string")).alias("cloud_id"), F.when(F.col("k") % 6 == 0, "skipped").otherwise("mapped").alias("status"))
    return fields.unionByName(users).withColumns({"notes": F.lit(None).cast("string"), "strategy": F.when((F.col("kind") == "user") & (F.col("status") == "skipped"), "remove")})


MAPS = """maps AS (SELECT 'field' AS kind, concat('customfield_', CAST(10000 + k AS VARCHAR)) AS server_id, CASE WHEN k % 7 <> 0 THEN concat('customfield_9', CAST(k AS VARCHAR)) END AS cloud_id, CASE WHEN k % 7 = 0 THEN 'skipped' ELSE 'mapped' END AS status
 FROM (SELECT DISTINCT c_custkey % 900 AS k FROM customer) WHERE k % 5 <> 0 UNION ALL
 SELECT 'user', concat('user', CAST(k AS VARCHAR)), concat('acc-', CAST(k AS VARCHAR)), CASE WHEN k % 6 = 0 THEN 'skipped' ELSE 'mapped' END FROM (SELECT DISTINCT c_custkey % 50 AS k FROM customer) WHERE k % 4 <> 0)"""
TOKENS = f"files AS ({o.duck('generated_files')}), toks AS ({o.tokens_of('field', '')} UNION ALL {o.tokens_of('user', '')}), {MAPS}, res AS (SELECT t.*, CASE WHEN status = 'skipped' AND t.kind = 'field' THEN concat('/* FIELD SKIPPED: ', t.server_id, ' — not needed in Cloud */ \"\"') WHEN status = 'skipped' THEN concat('/* USER REMOVED: ', t.server_id, ' — not needed in Cloud */ null') WHEN status = 'mapped' THEN concat('\"', cloud_id, '\"') END AS value FROM toks t LEFT JOIN maps m ON m.kind = t.kind AND m.server_id = t.server_id)"


@query(f"""WITH {TOKENS}, f AS (SELECT job_id, filename, max(CASE WHEN kind = 'field' THEN token END) AS ft, max(CASE WHEN kind = 'field' THEN value END) AS fv, max(CASE WHEN kind = 'user' THEN token END) AS ut, max(CASE WHEN kind = 'user' THEN value END) AS uv FROM res GROUP BY job_id, filename)
 SELECT job_id, filename, CASE WHEN uv IS NULL THEN c1 ELSE replace(c1, ut, uv) END AS content FROM (SELECT files.*, ut, uv, CASE WHEN fv IS NULL THEN content ELSE replace(content, ft, fv) END AS c1 FROM files LEFT JOIN f USING (job_id, filename))""")
def resolve_templates(spark, d):
    return templates.resolve(table(spark, d, "generated_files"), _file_mappings(spark, d))


@query(f"""WITH {TOKENS} SELECT files.job_id, files.filename, count(token) AS total, count(value) AS resolved, count(token) - count(value) AS unresolved, count(DISTINCT CASE WHEN value IS NULL THEN token END) AS distinct_unresolved FROM files LEFT JOIN res USING (job_id, filename) GROUP BY files.job_id, files.filename""")
def resolution_stats(spark, d):
    return templates.resolution_stats(table(spark, d, "generated_files"), _file_mappings(spark, d))


@query(f"""WITH {TOKENS} SELECT files.job_id, count(token) AS total, count(value) AS resolved, count(token) - count(value) AS unresolved, count(DISTINCT CASE WHEN value IS NULL THEN token END) AS distinct_unresolved FROM files LEFT JOIN res USING (job_id, filename) GROUP BY files.job_id""")
def session_resolution(spark, d):
    return templates.session_totals(table(spark, d, "generated_files"), _file_mappings(spark, d))


@query(f"""WITH {o.findings(['custom_field', 'user'])}, {MAPS} SELECT family, count(*) AS n, count(m.cloud_id) AS n_resolved FROM found f LEFT JOIN maps m ON m.server_id = f.entity AND m.kind = CASE family WHEN 'custom_field' THEN 'field' ELSE family END GROUP BY family""")
def resolve_ids(spark, d):
    found = findings.findings(table(spark, d, "scripts"), ["custom_field", "user"])
    return mappings.resolve_ids(found, _file_mappings(spark, d)).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count("cloud_id").alias("n_resolved"))


# --- pages and chunks

@query(f"SELECT page_id, {o.TITLE} AS title, sha256({o.page_text('html')}) AS text_hash, length({o.page_text('html')}) AS n_chars FROM pages")
def page_text(spark, d):
    t = tx.page_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", tx.page_title(F.col("html")).alias("title"), t.alias("t")).select("page_id", "title", tx.fingerprint(F.col("t")).alias("text_hash"), F.length("t").alias("n_chars"))


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")


CHUNKS = f"""WITH RECURSIVE {o.chunks()} SELECT substr(sha256(concat(url, '::', CAST(chunk_index AS VARCHAR))), 1, 32) AS chunk_id, url, CAST(chunk_index AS INTEGER) AS chunk_index, count(*) OVER (PARTITION BY url) AS total_chunks,
 sha256(content) AS content_hash, CAST(ceil(length(content) / 4.0) AS INTEGER) AS tokens, contains(content, '```') AS has_code FROM chunked"""


@query(CHUNKS)
def chunk_table(spark, d):
    return index.chunk_table(_docs(spark, d), CHUNK_TOKENS, OVERLAP_TOKENS, "\n").drop("content")


@query(CHUNKS)
def chunk_table_linear(spark, d):
    """The same chunks by the table function that takes texts of any length."""
    return index.chunk_table(_docs(spark, d), CHUNK_TOKENS, OVERLAP_TOKENS, "\n", cut_documents).drop("content")


BOTH = f"{o.pages('snapshot_1', 'p1')}, {o.pages('snapshot_2', 'p2')}"


def _two(spark, d):
    return index.page_table(table(spark, d, "snapshot_1")), index.page_table(table(spark, d, "snapshot_2"))


@query(f"WITH {BOTH} SELECT p2.url, p2.page_hash, p1.page_hash AS stored_hash, CASE WHEN p1.page_hash = p2.page_hash THEN 'skip' ELSE 'process' END AS action FROM p2 LEFT JOIN p1 USING (url)")
def changed_pages(spark, d):
    old, new = _two(spark, d)
    return index.changed_pages(new, old).select("url", "page_hash", "stored_hash", "action")


@query(f"WITH {BOTH}, a AS (SELECT url, page_hash, crawled_at FROM p1 UNION ALL SELECT url, page_hash, crawled_at FROM p2) SELECT url, arg_max(page_hash, crawled_at) AS page_hash, max(crawled_at) AS crawled_at FROM a GROUP BY url")
def latest_hash(spark, d):
    old, new = _two(spark, d)
    return index.latest_per_url(old.unionByName(new)).select("url", "page_hash", "crawled_at")


NO_CHUNKS = "chunk_id string, url string, chunk_index int, content string, content_hash string, crawled_at timestamp, created_at timestamp, embedding array<float>"


def _refreshed(spark, d):
    """A second snapshot over the chunks of the first: (chunks, report)."""
    pages = kept(index.page_table(table(spark, d, "snapshot_1")), "pages")
    first, _ = index.refresh(spark.createDataFrame([], NO_CHUNKS), pages.limit(0), table(spark, d, "snapshot_1"), AS_OF, hashed_vector(), CHUNK_TOKENS, OVERLAP_TOKENS, pages)
    return index.refresh(kept(first, "chunks"), pages, table(spark, d, "snapshot_2"), AS_OF, hashed_vector(), CHUNK_TOKENS, OVERLAP_TOKENS)


@query(f"""WITH RECURSIVE {o.refreshed()}, s AS ({o.duck('snapshot_2')}) SELECT (SELECT count(*) FROM s) AS attempted, (SELECT count(*) FROM s WHERE status BETWEEN 200 AND 299) AS succeeded, (SELECT count(*) FROM s WHERE NOT status BETWEEN 200 AND 299) AS failed, (SELECT count(*) FROM same) AS skipped,
 (SELECT count(*) FROM c2) AS chunks_created, (SELECT count(*) FROM live WHERE url IN (SELECT url FROM same)) AS chunks_skipped, (SELECT count(*) FROM live WHERE embedded) AS chunks_embedded""")
def crawl_run_report(spark, d):
    return _refreshed(spark, d)[1]


WIDTH = 64


RUN = ["attempted", "succeeded", "failed", "skipped", "chunks_created", "chunks_skipped", "chunks_embedded"]


@query(f"""WITH RECURSIVE {o.refreshed()}, s AS ({o.duck('snapshot_2')}), t AS ({o.duck('snapshot_1')}) SELECT 'first' AS run_id, 0 AS batch_id, (SELECT count(*) FROM t) AS attempted, (SELECT count(*) FROM t WHERE status BETWEEN 200 AND 299) AS succeeded, (SELECT count(*) FROM t WHERE NOT status BETWEEN 200 AND 299) AS failed,
 CAST(0 AS BIGINT) AS skipped, (SELECT count(*) FROM c1) AS chunks_created, CAST(0 AS BIGINT) AS chunks_skipped, (SELECT count(*) FROM c1) AS chunks_embedded, (SELECT count(*) FROM t WHERE NOT status BETWEEN 200 AND 299) AS n_errors
 UNION ALL SELECT 'second', 7, (SELECT count(*) FROM s), (SELECT count(*) FROM s WHERE status BETWEEN 200 AND 299), (SELECT count(*) FROM s WHERE NOT status BETWEEN 200 AND 299), (SELECT count(*) FROM same), (SELECT count(*) FROM c2), (SELECT count(*) FROM live WHERE url IN (SELECT url FROM same)), (SELECT count(*) FROM live WHERE embedded), (SELECT count(*) FROM s WHERE NOT status BETWEEN 200 AND 299)""")
def crawl_run_log(spark, d):
    """Two runs, the second of which is written twice, as a replayed batch is."""
    path = new_path(spark, "runs")
    one, two = table(spark, d, "snapshot_1"), table(spark, d, "snapshot_2")
    pages = kept(index.page_table(one), "pages")
    first, report = index.refresh(spark.createDataFrame([], NO_CHUNKS), pages.limit(0), one, AS_OF, hashed_vector(), CHUNK_TOKENS, OVERLAP_TOKENS, pages)
    runs.write_crawl_run(path, "first", 0, report, io.split_snapshots(one)[1])
    _, report = index.refresh(kept(first, "chunks"), pages, two, AS_OF, hashed_vector(), CHUNK_TOKENS, OVERLAP_TOKENS)
    for _ in range(2):
        runs.write_crawl_run(path, "second", 7, report, io.split_snapshots(two)[1])
    return runs.crawl_runs(spark, path).select("run_id", "batch_id", *RUN, "n_errors")


TARGETS = f"""t AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY category NULLS FIRST, priority NULLS FIRST, frequency NULLS FIRST) > 1 AS dup FROM ({o.duck('crawl_targets')}))"""


@query(f"""WITH {TARGETS} SELECT * FROM (SELECT 'too-few' AS violation, CAST(count(*) < {targets.LEAST} AS BIGINT) AS n FROM t UNION ALL SELECT 'duplicate-url', count(*) FILTER (WHERE dup) FROM t UNION ALL SELECT 'not-https', count(*) FILTER (WHERE NOT starts_with(url, 'https://')) FROM t
 UNION ALL SELECT 'unknown-category', count(*) FILTER (WHERE category NOT IN {targets.CATEGORIES}) FROM t UNION ALL SELECT 'unknown-priority', count(*) FILTER (WHERE priority NOT IN {targets.PRIORITIES}) FROM t UNION ALL SELECT 'unknown-frequency', count(*) FILTER (WHERE frequency IS NULL OR frequency NOT IN {targets.FREQUENCIES}) FROM t)""")
def crawl_target_constraints(spark, d):
    """How often each constraint is broken, as observed by the pass that writes the table."""
    told = targets.write_targets(table(spark, d, "crawl_targets"), new_path(spark, "targets"))
    return spark.createDataFrame(list(told.items()), "violation string, n long")


@query(f"""WITH {TARGETS} SELECT url, category, priority, frequency, violation FROM (SELECT *, unnest([CASE WHEN dup THEN 'duplicate-url' END, CASE WHEN NOT starts_with(url, 'https://') THEN 'not-https' END, CASE WHEN category NOT IN {targets.CATEGORIES} THEN 'unknown-category' END,
 CASE WHEN priority NOT IN {targets.PRIORITIES} THEN 'unknown-priority' END, CASE WHEN frequency IS NULL OR frequency NOT IN {targets.FREQUENCIES} THEN 'unknown-frequency' END]) AS violation FROM t) WHERE violation IS NOT NULL""")
def crawl_target_violations(spark, d):
    path = new_path(spark, "targets")
    targets.write_targets(table(spark, d, "crawl_targets"), path)
    return targets.violations(spark, path)


@query(f"WITH RECURSIVE {o.refreshed()} SELECT chunk_id, url, CAST(chunk_index AS INTEGER) AS chunk_index, content_hash, crawled_at, created_at, {WIDTH} AS width FROM live")
def refresh_index(spark, d):
    """A second snapshot over the chunks of the first, with vectors for what is new."""
    return _refreshed(spark, d)[0].select("chunk_id", "url", "chunk_index", "content_hash", "crawled_at", "created_at", F.size("embedding").alias("width"))


@query(f"SELECT url, crawled_at, concat('HTTP ', CAST(status AS VARCHAR)) AS error FROM ({o.duck('snapshot_2')}) WHERE NOT status BETWEEN 200 AND 299")
def crawl_errors(spark, d):
    return io.split_snapshots(table(spark, d, "snapshot_2"))[1]


def _chunk_rows(spark, d, name):
    """Chunks of a snapshot as rows of the index, one for each chunk id; every second length has a vector.

    A url stands for one page, the latest, as in ``index.refresh``; its time is the last of the url, so no text is worked out for it.
    """
    pages = index.page_table(table(spark, d, name))
    rows = index.chunk_table(index.latest_per_url(pages), CHUNK_TOKENS, OVERLAP_TOKENS).join(pages.groupBy("url").agg(F.max("crawled_at").alias("crawled_at")), "url")
    return rows.select("chunk_id", "url", "chunk_index", "content", "content_hash", "crawled_at", F.col("crawled_at").alias("created_at"), F.when(F.length("content") % 2 == 0, F.array(F.length("content").cast("float"))).alias("embedding"))


ROWS = f"{BOTH}, {o.snapshot_chunks('p1', 'c')}, {o.snapshot_chunks('p2', 'u0')}, u AS (SELECT * REPLACE (CAST(NULL AS BIGINT) AS emb) FROM u0)"


@query(f"""WITH RECURSIVE {ROWS} SELECT coalesce(u.chunk_id, c.chunk_id) AS chunk_id, coalesce(u.content_hash, c.content_hash) AS content_hash, coalesce(u.crawled_at, c.crawled_at) AS crawled_at, coalesce(c.created_at, u.crawled_at) AS created_at,
 CASE WHEN u.chunk_id IS NULL OR c.content_hash = u.content_hash THEN c.emb IS NOT NULL ELSE false END AS has_vector FROM c FULL JOIN u ON c.chunk_id = u.chunk_id""")
def chunk_merge(spark, d):
    new = _chunk_rows(spark, d, "snapshot_2").withColumn("embedding", F.lit(None).cast("array<float>"))
    merged = index.merge_chunks(_chunk_rows(spark, d, "snapshot_1"), new)
    return merged.select("chunk_id", "content_hash", "crawled_at", "created_at", F.col("embedding").isNotNull().alias("has_vector"))


@query(f"""WITH RECURSIVE {ROWS} SELECT 'orphan' AS kind, chunk_id FROM c WHERE url IN (SELECT url FROM p2) AND chunk_id NOT IN (SELECT chunk_id FROM u) UNION ALL SELECT 'stale', chunk_id FROM c WHERE crawled_at < TIMESTAMP '2024-03-05 00:00:00' - INTERVAL 60 DAY""")
def stale_and_orphans(spark, d):
    old, new = _chunk_rows(spark, d, "snapshot_1"), _chunk_rows(spark, d, "snapshot_2")
    lost = index.orphans(old, new, index.page_table(table(spark, d, "snapshot_2"))).select(F.lit("orphan").alias("kind"), "chunk_id")
    return lost.unionByName(index.stale(old, "2024-03-05 00:00:00").select(F.lit("stale").alias("kind"), "chunk_id"))


@query("""SELECT label AS category, grouping(label) AS is_total, count(*) AS total, count(*) FILTER (WHERE vec_id % 3 <> 0) AS embedded, min(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * vec_id) AS oldest, max(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * vec_id) AS newest FROM embeddings GROUP BY ROLLUP (label)""")
def index_stats(spark, d):
    return index.index_stats(_vectors(spark, d).withColumnRenamed("label", "category"))


def _vectors(spark, d):
    at = F.timestamp_millis(F.lit(1704067200000) + F.col("vec_id") * 3600000)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"), at.alias("crawled_at"), at.alias("created_at"))


@query("SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id % 3 = 0 ORDER BY vec_id LIMIT 100")
def pending_queue(spark, d):
    return index.pending(_vectors(spark, d), 100).select("chunk_id", "label")


def hashed_vector(dims: int = WIDTH):
    """Deterministic feature hashing of words: the embedder for tests and demonstrations."""

    def embed_fn(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dims
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h & 0x10000 else -1.0
            out.append(v)
        return pd.Series(out)

    return embed_fn


# --- retrieval

def _query_sides(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("category"))
    return e.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), e


@query(f"WITH {o.topk()} SELECT query_id, doc_id, similarity, rank FROM best")
def cosine_topk(spark, d):
    asked, docs = _query_sides(spark, d)
    return retrieval.cosine_topk(asked, docs, 4, 0.2)


@query(f"WITH {o.topk('AND q.label = d.label')} SELECT query_id, doc_id, similarity, rank FROM best")
def cosine_topk_by_category(spark, d):
    asked, docs = _query_sides(spark, d)
    return retrieval.cosine_topk(asked, docs, 4, 0.2, by_category=True)


@query(f"WITH {o.topk()}, m AS (SELECT query_id // 100 % 2 AS job_id, doc_id, max(similarity) AS similarity FROM best GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, doc_id) AS rank FROM m) WHERE rank <= 10")
def merged_ranking(spark, d):
    return retrieval.merged_ranking(cosine_topk(spark, d).withColumn("job_id", F.expr("query_id div 100 % 2")))


@query(f"WITH {o.topk()} SELECT query_id // 100 % 2 AS job_id, min(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id) AS stalest FROM best GROUP BY 1")
def stalest_hit(spark, d):
    at = F.timestamp_millis(F.lit(1704067200000) + F.col("doc_id") * 3600000)
    return retrieval.stalest(cosine_topk(spark, d).select(F.expr("query_id div 100 % 2").alias("job_id"), at.alias("retrieved_at")))


@query()
def ann_topk(spark, d):
    """The index is built once under the shared folder; the search opens it as a later job would."""
    asked, docs = _query_sides(spark, d)
    path = new_path(spark, "ann")
    VectorIndex.build(docs, path)
    return retrieval.ann_topk(asked, VectorIndex.open(spark, path), 4).select("query_id", "doc_id", "similarity", "rank")


@query(r"""WITH qs AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS terms FROM benchmark),
 h AS (SELECT query_id, doc_id, round(len(list_filter(terms, lambda t: contains(lower(coalesce(text, '')), t))) / len(terms), 6) AS similarity FROM qs JOIN documents ON true),
 b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM h WHERE similarity > 0) SELECT query_id, doc_id, similarity, rank FROM b WHERE rank <= 4""")
def keyword_topk(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.keyword_topk(asked, table(spark, d, "documents").select("doc_id", "text"), 4)


def _jobs(spark, d):
    v = readiness.verdicts(table(spark, d, "scripts"))
    return v.select(F.col("script_id").alias("job_id"), "target", "module", "needs_users", "needs_fields", "has_http")


@query(f"""WITH {o.verdicts()}, jobs AS (SELECT script_id AS job_id, v.target, v.module, n_user > 0 AS needs_users, n_custom_field > 0 AS needs_fields, n_http > 0 AS has_http FROM verdicts v JOIN profile USING (script_id)),
 q AS ({o.build_query_rows()}), d AS (SELECT job_id, query, min(o) AS o FROM q WHERE query IS NOT NULL GROUP BY ALL) SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY o) - 1 AS INTEGER) AS ord, query FROM d QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY o) <= 8""")
def query_builder(spark, d):
    return retrieval.build_queries(_jobs(spark, d))


@query(f"""WITH {o.topk()}, m AS (SELECT query_id // 100 % 2 AS job_id, doc_id, max(similarity) AS similarity FROM best GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, doc_id) AS rank FROM m),
 t AS (SELECT job_id, rank, concat(chr(10), '[DOC ', rank, '] ', 'doc ', r.doc_id, chr(10), 'Source: ', source, chr(10), 'Relevance: ', CAST(floor(similarity * 100 + 0.5) AS BIGINT), '%', chr(10), '---', chr(10), substr(text, 1, 800)) AS t FROM r JOIN documents USING (doc_id) WHERE rank <= 8)
 SELECT job_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY job_id""")
def context_window(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "source", F.col("text").alias("content"))
    return retrieval.context_window(merged_ranking(spark, d), docs)


# --- generated files

@query(f"WITH {o.lint()} SELECT * FROM lint")
def lint_issues(spark, d):
    return lint.lint(table(spark, d, "generated_files"))


@query(f"""WITH files AS ({o.duck('generated_files')}), l AS (SELECT job_id, filename, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)
 SELECT job_id, filename, line_no FROM l WHERE regexp_matches(regexp_replace(line, {o.q(packs.PLACEHOLDERS['field'])}, '', 'g'), 'customfield_[0-9]{{4,6}}')""")
def raw_field_ids(spark, d):
    """VAL_040 as it is meant: field ids outside of placeholders."""
    return lint.lint(table(spark, d, "generated_files"), strict=False).where("code = 'VAL_040'").select("job_id", "filename", "line_no")


@query(f"SELECT job_id, filename, sha256(regexp_replace(regexp_replace(content, '\\.getUsername\\s*\\(\\s*\\)', '.accountId', 'g'), '/rest/api/2/', '/rest/api/3/', 'g')) AS fixed_hash FROM ({o.duck('generated_files')})")
def lint_fixes(spark, d):
    return lint.fixed_files(table(spark, d, "generated_files")).select("job_id", "filename", tx.fingerprint(F.col("content")).alias("fixed_hash"))


@query(f"""WITH {o.lint()}, jobs AS (SELECT o_orderkey AS job_id FROM orders UNION ALL SELECT -c_custkey FROM customer), nf AS (SELECT job_id, count(*) AS n_files FROM files GROUP BY 1), ni AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE severity = 'error' AND NOT auto_fixed) AS e, count(*) FILTER (WHERE auto_fixed) AS f FROM lint GROUP BY 1), nm AS (SELECT job_id, count(*) AS m FROM manifest GROUP BY 1)
 SELECT job_id, coalesce(e, 0) + coalesce(m, 0) + CASE WHEN n_files IS NULL THEN 1 ELSE 0 END = 0 AS passed, coalesce(n, 0) + coalesce(m, 0) AS n_issues, coalesce(e, 0) + coalesce(m, 0) + CASE WHEN n_files IS NULL THEN 1 ELSE 0 END AS n_errors, coalesce(f, 0) AS n_fixed FROM jobs LEFT JOIN nf USING (job_id) LEFT JOIN ni USING (job_id) LEFT JOIN nm USING (job_id)""")
def lint_verdict(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id")).unionByName(table(spark, d, "customer").select((-F.col("c_custkey")).alias("job_id")))
    return lint.verdicts(jobs, table(spark, d, "generated_files"))


@query(f"WITH {o.lint()} SELECT * FROM manifest")
def manifest_check(spark, d):
    return lint.manifest_check(table(spark, d, "generated_files"))


DECLARED = """declared AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 6 = 0 THEN 'src/other.ts' ELSE 'src/index.ts' END AS filename, concat('ATLAS_ACCOUNT_ID("user', CAST(o_custkey % 50 AS {S}), '")') AS placeholder FROM orders)"""


@query(f"""WITH files AS ({o.duck('generated_files')}), {DECLARED.format(S='VARCHAR')} SELECT * FROM (SELECT d.job_id, d.filename, placeholder, CASE WHEN content IS NULL THEN 'VAL_050' WHEN NOT contains(content, placeholder) THEN 'VAL_051' END AS code FROM declared d LEFT JOIN files f ON f.job_id = d.job_id AND f.filename = d.filename) WHERE code IS NOT NULL""")
def placeholder_coverage(spark, d):
    declared = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", "CASE WHEN o_orderkey % 6 = 0 THEN 'src/other.ts' ELSE 'src/index.ts' END AS filename", "concat('ATLAS_ACCOUNT_ID(\"user', CAST(o_custkey % 50 AS STRING), '\")') AS placeholder")
    return lint.placeholder_coverage(declared, table(spark, d, "generated_files"))


# --- telemetry

RATE = "CASE model " + " ".join(f"WHEN '{m}' THEN {p}" for m, p in packs.MODEL_PRICES.items()) + f" ELSE CASE tier WHEN 'cheap' THEN {packs.CHEAP_PRICE} ELSE {packs.EXPENSIVE_PRICE} END END"
USAGE = ["user_id AS job_id", "CASE event_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'claude-sonnet-4-6' WHEN 2 THEN 'other-small' ELSE 'other-large' END AS model", "CASE WHEN event_id % 2 = 0 THEN 'cheap' ELSE 'expensive' END AS tier", "100 + event_id % 5000 AS tokens"]


@query(f"SELECT job_id, floor(sum(tokens * ({RATE})::DOUBLE) / 1000000 * 10000 + 0.5) / 10000 AS cost, count(DISTINCT model) AS n_models, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT {', '.join(USAGE)} FROM events) GROUP BY job_id")
def cost_rollup(spark, d):
    return telemetry.cost_rollup(table(spark, d, "events").selectExpr(*USAGE))


@query(f"SELECT stage, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(quantile_disc(ms, 0.95), 6) AS p95_ms FROM ({o.duck('job_events')}) GROUP BY stage")
def stage_timings(spark, d):
    return telemetry.stage_timings(table(spark, d, "job_events"))


#: A quantile from sketches may be off by this share of the ranks.
RANK_ERROR = 0.01


@query(f"SELECT stage, count(*) AS n, true AS within FROM ({o.duck('job_events')}) WHERE ms IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY stage")
def stage_quantiles(spark, d):
    """The 95th percentile of a month from hourly sketches, and whether its true rank is within the stated error."""
    events = table(spark, d, "job_events").where("ms IS NOT NULL")
    told = telemetry.window_quantiles(kept(telemetry.stage_sketches(events), "sketches"), "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    ranks = events.where("ts >= '2024-01-01' AND ts < '2024-02-01'").join(told.select("stage", "quantile_ms"), "stage").groupBy("stage").agg(F.avg((F.col("ms") < F.col("quantile_ms")).cast("int")).alias("low"), F.avg((F.col("ms") <= F.col("quantile_ms")).cast("int")).alias("high"))
    return told.join(ranks, "stage").select("stage", "n", ((F.col("low") <= 0.95 + RANK_ERROR) & (F.col("high") >= 0.95 - RANK_ERROR)).alias("within"))


STATUS = f"last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM ({o.duck('job_events')})) WHERE rn = 1), status AS (SELECT job_id, seq, ts, stage, CASE stage " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in packs.JOB_PROGRESS.items()) + " END AS progress, stage IN ('completed', 'failed') AS is_terminal FROM last)"


@query(f"WITH {STATUS} SELECT * FROM status")
def job_status_latest(spark, d):
    return telemetry.latest_status(table(spark, d, "job_events"))


@query(f"WITH {STATUS} SELECT * FROM status WHERE CASE stage WHEN 'completed' THEN ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR WHEN 'failed' THEN ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR ELSE true END")
def retention(spark, d):
    return telemetry.retained(telemetry.latest_status(table(spark, d, "job_events")), "2024-01-31 00:00:00")


@query(f"SELECT date_trunc('hour', ts) AS hour, stage, count(*) AS n, round(avg(ms), 6) AS mean_ms FROM ({o.duck('job_events')}) GROUP BY ALL")
def stage_windows(spark, d):
    from ..streaming.streams import stage_windows as windows

    return windows(table(spark, d, "job_events")).select(F.col("window.start").alias("hour"), "stage", "n", F.round("mean_ms", 6).alias("mean_ms"))


# --- workflows

KNOWN = " OR ".join(f"type = '{t}'" for t in packs.WORKFLOW_TYPES)


@query(f"""SELECT workflow_id, concat('WF ', CAST(workflow_id AS VARCHAR)) AS workflow_name, action_name AS transition, 'Open' AS from_status, to_status, type, script, CASE WHEN type LIKE '%Validator' THEN 'validator' ELSE 'post-function' END AS module, 'groovy' AS language, 0 AS script_index,
 concat('wf-', CAST(workflow_id AS VARCHAR), '-', lower(action_name), CASE WHEN type LIKE '%Validator' THEN '-validator' ELSE '-post-function' END, '-0.groovy') AS filename, count(*) OVER (PARTITION BY workflow_id) AS total_scripts FROM ({o.duck('workflow_rows')}) WHERE {KNOWN}""")
def workflow_scripts(spark, d):
    return workflow.scripts(table(spark, d, "workflow_exports")).select("workflow_id", "workflow_name", "transition", "from_status", "to_status", "type", "script", "module", "language", "script_index", "total_scripts", "filename")


@query(f"""SELECT workflow_id, 'unknown-type' AS warning, type AS detail FROM ({o.duck('workflow_rows')}) WHERE NOT ({KNOWN})
 UNION ALL SELECT -1 - c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'no-actions' WHEN 1 THEN 'external-file' ELSE 'no-scripts' END, CASE WHEN c_custkey % 3 = 1 THEN '77' END FROM customer WHERE c_custkey % 10 = 0""")
def workflow_warnings(spark, d):
    return workflow.warnings(table(spark, d, "workflow_exports"))
