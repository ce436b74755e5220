"""SQL forms of the queries, built from the same rule packs."""

from __future__ import annotations

from ..operators import retrieval
from ..sources.estate import text
from . import rulepacks as packs
from .params import AS_OF, CHUNK_TOKENS, OVERLAP_TOKENS

duck = lambda name: text(name, "duckdb")
q = lambda s: "'" + s.replace("'", "''") + "'"
TRIM = r"'^\s+|\s+\z'"
trim = lambda c: f"regexp_replace({c}, {TRIM}, '', 'g')"


def lines(source: str, key: str = "script_id") -> str:
    return f"(SELECT {key}, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM ({source}))"


def raw_findings(families: list[str]) -> str:
    parts = []
    for f in families:
        for k, (p, g, a) in enumerate(packs.FAMILIES[f], 1):
            parts.append(
                f"SELECT script_id, line_no, line, {q(f)} AS family, {k} AS rule_ord, unnest(regexp_extract_all(line, {q(p)}, 0)) AS raw0,"
                f" unnest(regexp_extract_all(line, {q(p)}, {g})) AS ent, generate_subscripts(regexp_extract_all(line, {q(p)}, 0), 1) - 1 AS pos, {q(a)} AS attr FROM lines WHERE regexp_matches(line, {q(p)})"
            )
    return "\nUNION ALL ".join(parts)


def findings(families: list[str] | None = None) -> str:
    """CTEs that end in ``found``: script_id, line_no, family, rule_ord, pos, raw, entity, attr, usage, method, dynamic."""
    families = families or list(packs.FAMILIES)
    return f"""scripts AS ({duck('scripts')}), lines AS {lines('SELECT * FROM scripts')}, hits AS ({raw_findings(families)}),
allfound AS (SELECT script_id, line_no, family, rule_ord, pos,
 CASE WHEN family IN ('http', 'script_dep') THEN {trim('raw0')} ELSE raw0 END AS raw,
 CASE WHEN family = 'internal_api' THEN concat('/rest/api/', attr, '/', ent) ELSE ent END AS entity, attr,
 CASE WHEN family = 'custom_field' THEN CASE WHEN regexp_matches(line, {q(packs.FIELD_WRITE)}) THEN 'write' WHEN regexp_matches(line, {q(packs.FIELD_READ)}) THEN 'read' WHEN regexp_matches(line, {q(packs.FIELD_SEARCH)}) THEN 'search' ELSE 'unknown' END END AS usage,
 CASE WHEN family = 'http' THEN attr WHEN family = 'internal_api' AND regexp_extract(line, {q(packs.HTTP_METHOD)}, 1) <> '' THEN upper(regexp_extract(line, {q(packs.HTTP_METHOD)}, 1)) WHEN family = 'internal_api' THEN 'unknown' END AS method,
 CASE WHEN family = 'http' THEN contains(ent, '${{') OR contains(ent, '+') OR regexp_matches(ent, '\\$\\w+') END AS dynamic
 FROM hits WHERE NOT (family = 'http' AND (regexp_matches(ent, '(?i)/rest/api/') OR regexp_matches(ent, 'localhost|127\\.0\\.0\\.1')))),
found AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY script_id, family, raw ORDER BY line_no, rule_ord, pos) AS rn FROM allfound) WHERE rn = 1)"""


def n_hits(column: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({column}, {q(p)}) AS INTEGER)" for p in patterns) + ")"


LOC = f"len(list_filter(list_transform(string_split(content, chr(10)), lambda x: {trim('x')}), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '*')))"


def language_rows() -> str:
    parts = []
    for k, (lang, s) in enumerate(packs.LANGUAGES.items(), 1):
        n = {kind: n_hits("c", p) for kind, p in s.items()}
        ext = [e for e, l in packs.EXTENSIONS.items() if l == lang]
        part = lambda w, base, step, h: f"CASE WHEN {h} > 0 THEN {w} * least(1.0::DOUBLE, {base}::DOUBLE + {h} * {step}::DOUBLE) ELSE 0 END"
        score = f"{part(30.0, 0.4, 0.2, n['syntax'])} + {part(20.0, 0.0, 0.5, n['imports'])} + {part(10.0, 0.0, 0.3, n['apis'])} - 15.0 * {n['negative']}"
        parts.append(f"SELECT script_id, {k} AS ord, {q(lang)} AS language, round((greatest(0.0, {score}) + CASE WHEN regexp_extract(filename, '(\\.[^.]*)\\z', 1) IN ({', '.join(map(q, ext))}) THEN 40.0 ELSE 0.0 END)::DOUBLE, 6) AS score FROM (SELECT *, {trim('content')} AS c FROM scripts)")
    return " UNION ALL ".join(parts)


def module_rows() -> str:
    parts = []
    for k, (mod, (w, ps)) in enumerate(packs.MODULES.items(), 1):
        parts.append(f"SELECT script_id, {k} AS ord, {q(mod)} AS module, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE floor({w} * least(3.0::DOUBLE, 1.0 + (n - 1) * 0.3::DOUBLE) * 10 + 0.5 + 1e-9) / 10 END AS score FROM (SELECT script_id, {n_hits('content', ps)} AS n FROM scripts)")
    return " UNION ALL ".join(parts)


def trigger_rows() -> str:
    return " UNION ALL ".join(f"SELECT script_id, {k} AS ord, {q(t)} AS trigger, {n_hits('content', ps)} AS score FROM scripts" for k, (t, ps) in enumerate(packs.TRIGGERS.items(), 1))


LANG = """lang_rows AS ({rows}),
lang AS (SELECT script_id, CASE WHEN top >= 5 THEN l ELSE 'unknown' END AS language,
 CASE WHEN top < 5 THEN 'low' WHEN top >= 70 AND top - second >= 20 THEN 'high' WHEN top >= 40 AND top - second >= 10 THEN 'medium' ELSE 'low' END AS language_confidence,
 CASE WHEN top >= 5 THEN top ELSE 0.0 END AS language_score
 FROM (SELECT script_id, max(CASE WHEN rn = 1 THEN score END) AS top, max(CASE WHEN rn = 2 THEN score END) AS second, max(CASE WHEN rn = 1 THEN language END) AS l
 FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY score DESC, ord) AS rn FROM lang_rows) GROUP BY script_id))"""


def lang() -> str:
    return LANG.format(rows=language_rows())


def module() -> str:
    pick = lambda rows, col: f"SELECT script_id, CASE WHEN score > 0 THEN {col} ELSE 'unknown' END AS {col} FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY score DESC, ord) AS rn FROM ({rows})) WHERE rn = 1"
    return f"mods AS ({pick(module_rows(), 'module')}), trigs AS ({pick(trigger_rows(), 'trigger')})"


def counts_select() -> str:
    out = [f"count(*) FILTER (WHERE family = {q(f)}) AS n_{f}" for f in packs.FAMILIES]
    out += [f"count(*) FILTER (WHERE family = 'deprecated' AND attr LIKE {q('%|' + r)}) AS r_{r.replace('-', '_')}" for r in packs.REASONS]
    out += [
        "count(*) FILTER (WHERE family = 'internal_api' AND attr = '2') AS n_v2", "count(*) FILTER (WHERE family = 'internal_api' AND attr = '3') AS n_v3",
        "count(*) FILTER (WHERE family = 'http' AND dynamic) AS n_dynamic", "count(*) FILTER (WHERE family = 'user' AND contains(raw, 'runAs')) AS n_run_as",
        "count(*) FILTER (WHERE family = 'internal_api' AND regexp_matches(entity, 'search|picker')) AS n_search_or_picker", "count(*) FILTER (WHERE family = 'internal_api' AND contains(entity, 'search')) AS n_search",
    ]
    return ", ".join(out)


def count_columns() -> list[str]:
    return [f"n_{f}" for f in packs.FAMILIES] + [f"r_{r.replace('-', '_')}" for r in packs.REASONS] + ["n_v2", "n_v3", "n_dynamic", "n_run_as", "n_search_or_picker", "n_search"]


def profile() -> str:
    """CTEs up to ``profile``."""
    points = " + ".join([f"{w} * coalesce(n_{f}, 0)" for f, w in packs.COMPLEXITY.items()] + ["loc // 50"])
    level = " ".join(f"WHEN pts >= {n} THEN {q(l)}" for n, l in packs.COMPLEXITY_LEVELS)
    cols = ", ".join(f"coalesce({c}, 0) AS {c}" for c in count_columns())
    return f"""{findings()}, counts AS (SELECT script_id, {counts_select()} FROM found GROUP BY script_id), {lang()}, {module()},
base AS (SELECT script_id, {LOC} AS loc FROM scripts),
pre AS (SELECT base.script_id, loc, language, language_confidence, module, trigger, {cols}, {points} AS pts FROM base JOIN lang USING (script_id) JOIN mods USING (script_id) JOIN trigs USING (script_id) LEFT JOIN counts USING (script_id)),
profile AS (SELECT *, CASE {level} ELSE 'low' END AS complexity FROM pre)"""


def issues() -> str:
    parts = [f"SELECT script_id, {q(c)} AS code, {q(l)} AS level, {q(cat)} AS category, {str(n).lower()} AS needs_mapping FROM profile WHERE {cond}" for c, l, cat, n, cond in packs.READINESS]
    return f"{profile()}, issues AS ({' UNION ALL '.join(parts)})"


def shown_issues() -> str:
    """``issues`` with the first line and the expressions."""
    parts = []
    for code, level, category, needs, cond in packs.READINESS:
        rule = packs.EVIDENCE[code]
        if isinstance(rule, str):
            line, told, side = "NULL", q(rule), ""
        else:
            where, field, most, otherwise = rule
            field = "split_part(attr, '|', 1)" if field == "class" else field
            line, told = "x[1].l", f"coalesce(array_to_string(list_transform(x[1:{most}], lambda e: e.t), ', '), '')"
            told = told if otherwise is None else f"coalesce(nullif({told}, ''), {q(otherwise)})"
            side = f" LEFT JOIN (SELECT script_id, list({{'l': line_no, 't': {field}}} ORDER BY line_no, rule_ord, pos) AS x FROM found WHERE {where.format(f='')} GROUP BY script_id) USING (script_id)"
        parts.append(f"SELECT script_id, {q(code)} AS code, {q(level)} AS level, {q(category)} AS category, {str(needs).lower()} AS needs_mapping, CAST({line} AS INTEGER) AS first_line, {told} AS affected FROM profile{side} WHERE {cond}")
    return f"{profile()}, shown AS ({' UNION ALL '.join(parts)})"


def operations() -> str:
    parts = [f"SELECT script_id, {k} AS ord, true AS mappable, {q(l)} AS label, regexp_extract(content, {q(p)}, 0) AS expression, {q(e)} AS equivalent FROM scripts" for k, (p, l, e) in enumerate(packs.MAPPABLE, 1)]
    parts += [f"SELECT script_id, {100 + k}, false, {q(l)}, regexp_extract(content, {q(p)}, 0), NULL FROM scripts" for k, (p, l) in enumerate(packs.UNMAPPABLE, 1)]
    return f"ops AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE expression <> '')"


def suitability() -> str:
    mapped = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in packs.AUTOMATION_TRIGGERS.items())
    return f"""{issues()}, {operations()},
opn AS (SELECT script_id, count(*) FILTER (WHERE mappable) AS n_mappable, count(*) FILTER (WHERE NOT mappable) AS n_unmappable FROM ops GROUP BY script_id),
fit0 AS (SELECT profile.*, coalesce(n_mappable, 0) AS n_mappable, coalesce(n_unmappable, 0) AS n_unmappable, CASE trigger {mapped} END AS mapped_trigger FROM profile LEFT JOIN opn USING (script_id)),
fit1 AS (SELECT *, CASE WHEN mapped_trigger IS NULL THEN 'no-trigger' WHEN r_server_only_java_api > 0 OR r_filesystem_access > 0 OR r_direct_sql > 0 THEN 'server-only' WHEN n_script_dep > 0 THEN 'script-dependencies'
 WHEN complexity IN ('high', 'critical') THEN 'complexity' WHEN n_unmappable > 0 THEN 'unmappable-operations' WHEN n_mappable = 0 THEN 'no-operations' ELSE 'suitable' END AS rationale FROM fit0),
fit AS (SELECT script_id, rationale = 'suitable' AS suitable, CASE rationale WHEN 'unmappable-operations' THEN 'medium' WHEN 'suitable' THEN CASE WHEN complexity = 'low' THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence, rationale, mapped_trigger, n_mappable, n_unmappable FROM fit1)"""


def verdicts() -> str:
    cats = sorted({c for _, _, c, _, _ in packs.READINESS})
    flags = ", ".join(f"coalesce(bool_or(category = {q(c)}), false) AS c_{c.replace('-', '_')}" for c in cats)
    names = ", ".join(f"coalesce(c_{c.replace('-', '_')}, false) AS c_{c.replace('-', '_')}" for c in cats)
    target = " ".join(f"WHEN {cond} THEN {q(t)}" for cond, t in packs.TARGETS)
    hours = lambda k: "CASE complexity " + " ".join(f"WHEN {q(c)} THEN {p[k]}::DOUBLE" for c, p in packs.EFFORT.items()) + " END"
    return f"""{suitability()}, agg AS (SELECT script_id, count(*) AS n_issues, count(*) FILTER (WHERE level = 'red') AS n_red, count(*) FILTER (WHERE level = 'yellow') AS n_yellow, {flags} FROM issues GROUP BY script_id),
j AS (SELECT profile.*, coalesce(n_issues, 0) AS n_issues, coalesce(n_red, 0) AS n_red, coalesce(n_yellow, 0) AS n_yellow, {names}, suitable, confidence FROM profile LEFT JOIN agg USING (script_id) JOIN fit USING (script_id)),
verdicts AS (SELECT script_id, language, module, trigger, loc, complexity, n_issues, greatest(0, least(100, 100 - 25 * n_red - 10 * n_yellow)) AS score,
 CASE WHEN n_red > 0 THEN 'red' WHEN n_yellow > 0 THEN 'yellow' ELSE 'green' END AS level, CASE {target} ELSE 'forge-native' END AS target, {hours(0)} AS consultant_hours, {hours(1)} AS assisted_hours FROM j)"""


PORTFOLIO_SUMS = "count(*) AS n_scripts, round(avg(score), 6) AS avg_score, sum(consultant_hours) AS consultant_hours, sum(assisted_hours) AS assisted_hours"
UNTAG = lambda c: f"regexp_replace({c}, '<[^>]+>', '', 'g')"


def page_text(html: str) -> str:
    """Page text where no <pre> and no h2 to h4 occurs, as in the given pages."""
    t = f"regexp_replace({html}, '(?i)<h1[^>]*>\\s*(.*?)\\s*</h1>', chr(10) || '# ' || '\\1' || chr(10), 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?i)</p>', chr(10) || chr(10), 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g')"
    t = UNTAG(t)
    for e, p in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = f"replace({t}, {q(e)}, {q(p)})"
    return trim(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


TITLE = f"""CASE WHEN regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1) <> '' THEN {trim("regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), '(?i)\\s*[|\\-–]\\s*Atlassian Developer.*', '')")}
 WHEN regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1) <> '' THEN {trim("regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1)")} ELSE 'Untitled' END"""


def pages(snapshot: str, name: str) -> str:
    return f"{name} AS (SELECT url, {TITLE} AS title, {page_text('html')} AS text, crawled_at, sha256({page_text('html')}) AS page_hash FROM ({duck(snapshot)}) WHERE status BETWEEN 200 AND 299)"


def chunks() -> str:
    """Greedy packing of lines as a recursive query; ``chunked`` has url, chunk_index and content."""
    docs = f"docs AS (SELECT CAST(doc_id AS VARCHAR) AS url, text FROM documents)"
    return f"{docs}, {cut_of('docs', 'chunked', CHUNK_TOKENS, OVERLAP_TOKENS, 1)}"


def cut_of(source: str, name: str, most: int, overlap: int, feeds: int = 2) -> str:
    """CTEs that cut (url, text) of ``source`` at headings and by paragraphs (parted by ``feeds`` line feeds or more); no text may hold a fence."""
    sep, gap = " || ".join(["chr(10)"] * feeds), "\\n" * (feeds - 1) + "\\n+"
    size = lambda c: f"ceil(length({c}) / 4.0)"
    joined = f"w.cur || {sep} || x.p"
    fits = f"{size(joined)} <= {most}"
    n = name
    return f"""{n}_split AS (SELECT url, string_split(regexp_replace(text, '\\n(#{{1,4}}\\s)', chr(1) || chr(10) || '\\1', 'g'), chr(1)) AS parts FROM {source}),
{n}_src AS (SELECT url, part, {trim('s')} AS text FROM (SELECT url, unnest(parts) AS s, generate_subscripts(parts, 1) AS part FROM {n}_split) WHERE {trim('s')} <> ''),
{n}_paras AS (SELECT url, part, unnest(regexp_split_to_array(text, '{gap}')) AS p, generate_subscripts(regexp_split_to_array(text, '{gap}'), 1) AS k FROM {n}_src WHERE {size('text')} > {most}),
{n}_walk AS (SELECT url, part, k, p AS cur, CAST(NULL AS VARCHAR) AS done, CAST(0 AS BIGINT) AS n FROM (SELECT url, part, k, p FROM {n}_paras WHERE k = 1)
 UNION ALL SELECT w.url, w.part, x.k, CASE WHEN {fits} THEN {joined} ELSE x.p END, CASE WHEN {fits} THEN NULL ELSE w.cur END, CASE WHEN {fits} THEN w.n ELSE w.n + 1 END
 FROM {n}_walk w JOIN {n}_paras x ON x.url = w.url AND x.part = w.part AND x.k = w.k + 1),
{n}_last AS (SELECT url, part, max(k) AS k FROM {n}_paras GROUP BY url, part),
{n}_pieces AS (SELECT url, part, n - 1 AS i, {trim('done')} AS s FROM {n}_walk WHERE done IS NOT NULL UNION ALL SELECT url, part, n, {trim('cur')} FROM {n}_walk JOIN {n}_last USING (url, part, k)
 UNION ALL SELECT url, part, 0, text FROM {n}_src WHERE {size('text')} <= {most}),
{n}_numbered AS (SELECT url, row_number() OVER (PARTITION BY url ORDER BY part, i) - 1 AS chunk_index, s, lag(s) OVER (PARTITION BY url ORDER BY part, i) AS prev FROM {n}_pieces),
{n} AS (SELECT url, chunk_index, CASE WHEN prev IS NULL THEN s ELSE {trim(f"substr(prev, CAST(greatest(1, length(prev) - {4 * overlap} + 1) AS INTEGER)) || chr(10) || chr(10) || s")} END AS content FROM {n}_numbered)"""


CHUNK_ID = "substr(sha256(concat(url, '::', CAST(chunk_index AS VARCHAR))), 1, 32)"


def snapshot_chunks(pages_cte: str, name: str) -> str:
    """``name``: the chunks of a snapshot's pages as rows of the index; every second length has a vector."""
    return f"""{cut_of(pages_cte, name + '_cut', CHUNK_TOKENS, OVERLAP_TOKENS)},
{name} AS (SELECT {CHUNK_ID} AS chunk_id, url, chunk_index, content, sha256(content) AS content_hash, crawled_at, crawled_at AS created_at, CASE WHEN length(content) % 2 = 0 THEN length(content) END AS emb FROM {name}_cut JOIN {pages_cte} USING (url))"""


def refreshed() -> str:
    """CTEs that end in ``live``: a second snapshot over the chunks of the first."""
    return f"""{pages('snapshot_1', 'p1')}, {pages('snapshot_2', 'p2')}, changed AS (SELECT p2.url, p2.crawled_at, p2.text FROM p2 LEFT JOIN p1 USING (url) WHERE p1.page_hash IS DISTINCT FROM p2.page_hash),
same AS (SELECT p2.url, p2.crawled_at FROM p2 JOIN p1 USING (url) WHERE p1.page_hash = p2.page_hash), {snapshot_chunks('p1', 'c1')}, {snapshot_chunks('changed', 'c2')},
moved AS (SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, coalesce(n.url, o.url) AS url, coalesce(n.chunk_index, o.chunk_index) AS chunk_index, coalesce(n.content, o.content) AS content, coalesce(n.content_hash, o.content_hash) AS content_hash,
 coalesce(n.crawled_at, same.crawled_at, o.crawled_at) AS crawled_at, coalesce(o.created_at, n.crawled_at) AS created_at, o.content_hash IS DISTINCT FROM n.content_hash AND n.chunk_id IS NOT NULL AS embedded
 FROM c1 o FULL JOIN c2 n USING (chunk_id) LEFT JOIN same ON same.url = o.url WHERE n.chunk_id IS NOT NULL OR o.url NOT IN (SELECT url FROM changed)),
live AS (SELECT * FROM moved WHERE crawled_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY)"""


def topk(extra: str = "") -> str:
    return f"""hits AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings d ON true {extra} WHERE q.vec_id % 100 = 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM hits WHERE similarity >= 0.2) WHERE rank <= 4)"""


def state() -> str:
    return f"""ev AS ({duck('mapping_events')}),
state AS (SELECT session_id, kind, server_id, CASE WHEN arg_max(op, seq) = 'map' THEN 'mapped' ELSE 'skipped' END AS status, arg_max(cloud_id, seq) FILTER (WHERE op = 'map') AS cloud_id,
 arg_max(notes, seq) FILTER (WHERE notes IS NOT NULL) AS notes, max(seq) AS seq, CASE WHEN kind = 'user' AND arg_max(op, seq) = 'skip' THEN 'remove' END AS strategy FROM ev GROUP BY session_id, kind, server_id)"""


def validated() -> str:
    return f"""{state()}, cat AS ({duck('catalogue')}),
val AS (SELECT session_id, kind, server_id, s.cloud_id, CASE WHEN status = 'mapped' AND name IS NULL THEN 'unmapped' ELSE status END AS status, CASE WHEN status = 'mapped' THEN name END AS cloud_name,
 CASE WHEN status = 'mapped' AND name IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS validated_at, CASE WHEN status = 'mapped' AND name IS NULL THEN concat('not in catalogue: ', s.cloud_id) ELSE notes END AS notes FROM state s LEFT JOIN cat c ON s.cloud_id = c.cloud_id)"""


def lint() -> str:
    rules = " UNION ALL ".join(f"SELECT job_id, filename, line_no, {q(c)} AS code, {q(s)} AS severity, {str(f is not None).lower()} AS auto_fixed FROM glines WHERE regexp_matches(line, {q(p)})" for c, s, p, f in packs.LINT)
    keys = " UNION ALL ".join(f"SELECT job_id, 'VAL_061' AS code, {q(k)} AS missing FROM files WHERE filename = 'manifest.yml' AND NOT contains(content, {q(k)})" for k in packs.MANIFEST_KEYS)
    return f"""files AS ({duck('generated_files')}), glines AS (SELECT job_id, filename, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files),
lint AS ({rules}), manifest AS (SELECT DISTINCT job_id, 'VAL_060' AS code, 'manifest.yml' AS missing FROM files WHERE job_id NOT IN (SELECT job_id FROM files WHERE filename = 'manifest.yml') UNION ALL {keys})"""


def tokens_of(kind: str, at: str) -> str:
    return f"SELECT job_id, filename, {q(kind)} AS kind, unnest(regexp_extract_all(content, {q(packs.PLACEHOLDERS[kind])}, 0)) AS token, unnest(regexp_extract_all(content, {q(packs.PLACEHOLDERS[kind])}, 1)) AS server_id FROM files"


def build_query_rows() -> str:
    target = "CASE target " + " ".join(f"WHEN {q(t)} THEN replace({q(s)}, '{{m}}', module)" for t, s in retrieval.TARGET_QUERIES.items()) + " END"
    mod = "CASE module " + " ".join(f"WHEN {q(t)} THEN {q(s)}" for t, s in retrieval.MODULE_QUERIES.items()) + " END"
    rows = [(1, target), (2, mod)] + [(3 + k, f"CASE WHEN {c} THEN {q(s)} END") for k, (c, s) in enumerate(retrieval.NEED_QUERIES.items())] + [(6, f"replace({q(retrieval.SCOPE_QUERY)}, '{{m}}', module)")]
    return " UNION ALL ".join(f"SELECT job_id, {k} AS o, {e} AS query FROM jobs" for k, e in rows)
