"""Estate operators: literal fixtures, edge cases, invariants."""

import time

import pytest
from pyspark.sql import functions as F

from estatelens.functions import text as tx
from estatelens.operators import classify, findings, index, lint, mappings, readiness, retrieval, targets, telemetry, templates, workflow
from estatelens.plans import rulepacks as packs
from estatelens.sources import io

GROOVY = """import com.atlassian.jira.component.ComponentAccessor
def cfm = ComponentAccessor.getCustomFieldManager()
def cf = cfm.getCustomFieldObject("customfield_10048")
issue.setCustomFieldValue(cf, "x") // customfield_10048
def u = userManager.getUserByName("jsmith")
def g = groupManager.getGroup("jira-admins")
Unirest.post("https://api.example.com/hook")
Unirest.get("/rest/api/2/issue/ABC-1")
issue.store()"""
SIL = """// SIL Validator
include "lib/util.sil"
lfHide("customfield_10010");
string s = ldapSearch("x");
readFromTextFile("/tmp/x");
return false;"""


@pytest.fixture(scope="module")
def scripts(spark):
    rows = [(1, "a.groovy", GROOVY), (2, "b.sil", SIL), (3, "c.txt", ""), (4, "d.java", "public class A extends B {\n  new File (\"x\");\n}"), (5, "e.groovy", None)]
    return spark.createDataFrame(rows, "script_id long, filename string, content string")


def of(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.collect()


def test_findings_of_each_family(scripts):
    found = findings.findings(scripts).cache()
    assert [(r.entity, r.usage) for r in of(found, script_id=1, family="custom_field")] == [("customfield_10048", "read")]  # the first line decides
    assert {r.raw for r in of(found, script_id=1, family="user")} == {'userManager.getUserByName("jsmith")', 'getUserByName("jsmith")'}  # overlapping patterns count twice
    assert [(r.entity, r.method, r.dynamic) for r in of(found, script_id=1, family="http")] == [("https://api.example.com/hook", "POST", False)]
    assert [(r.entity, r.method) for r in of(found, script_id=1, family="internal_api")] == [("/rest/api/2/issue/ABC", "GET")]
    assert [r.entity for r in of(found, script_id=2, family="script_dep")] == ["lib/util.sil"]
    assert {r.attr.split("|")[1] for r in of(found, script_id=2, family="deprecated")} == {"dom-manipulation", "ldap-access", "local-file-read"}
    assert found.groupBy("script_id", "family", "raw").count().where("count > 1").isEmpty()
    assert of(found, script_id=3) == of(found, script_id=5) == []


def test_merge_and_edges(spark, scripts):
    found = findings.findings(scripts)
    merged = findings.merge_sources(found.where("rule_ord = 1"), found)
    assert merged.where("script_id = 1 AND family = 'user'").count() == 1
    lib = spark.createDataFrame([(9, "Util.sil")], "script_id long, filename string")
    assert [(r.imported_path, r.target_script_id) for r in findings.script_edges(found, lib).collect() if r.src_script_id == 2] == [("lib/util.sil", 9)]


def test_dynamic_regions_do_not_overlap(spark):
    content = "\n".join("x.metaClass.y = 1" if k in (3, 4, 5, 6, 20) else f"l{k}" for k in range(1, 26))
    rows = findings.dynamic_regions(spark.createDataFrame([(1, "a", content)], "script_id long, filename string, content string")).orderBy("region").collect()
    assert [(r.first_line, r.last_line) for r in rows] == [(1, 5), (4, 8), (18, 22)]


def test_classification(scripts):
    lang = {r.script_id: r.language for r in classify.classify_language(scripts).collect()}
    assert (lang[1], lang[2], lang[4]) == ("groovy", "sil", "java")
    module = {r.script_id: r.module for r in classify.classify_module(scripts).collect()}
    assert module[2] == "live-field" and module[3] == "unknown"


def test_readiness(scripts):
    rows = {r.script_id: r for r in readiness.verdicts(scripts.where("content IS NOT NULL")).collect()}
    assert (rows[2].level, rows[2].target) == ("red", "manual-rewrite") and rows[4].target == "manual-rewrite"
    assert rows[1].level == "yellow" and rows[1].complexity == "critical" and all(0 <= r.score <= 100 for r in rows.values())
    issues = readiness.issues(readiness.profile(scripts.where("content IS NOT NULL")))
    codes = {r.code for r in issues.where("script_id = 2").collect()}
    assert {"CR-031", "CR-036", "CR-039", "CR-040", "CR-022", "CR-033"} <= codes
    worst = issues.groupBy("script_id").agg(F.max(F.when(F.col("level") == "red", 2).when(F.col("level") == "yellow", 1).otherwise(0)).alias("w"))
    assert {(r.script_id, ["green", "yellow", "red"][r.w]) for r in worst.collect()} <= {(k, v.level) for k, v in rows.items()}


def test_partition_count_does_not_matter(scripts):
    want = sorted(map(str, readiness.verdicts(scripts).collect()))
    for n in (1, 7):
        assert sorted(map(str, readiness.verdicts(scripts.repartition(n)).collect())) == want


def test_rejects(spark):
    rows = [(1, "a.exe", "x"), (2, "a.txt", " \n"), (3, "a.sil", "y" * 50_001), (4, "a.SIL", "ok"), (5, "noext", "x"), (6, "a.xml", None)]
    good, bad = io.split_rejects(spark.createDataFrame(rows, "script_id long, filename string, content string"))
    assert {r.script_id: r.reason for r in bad.collect()} == {1: "unsupported-extension", 2: "PARSE_001", 3: "PARSE_002", 5: "unsupported-extension", 6: "PARSE_001"}
    assert [r.script_id for r in good.collect()] == [4]


def test_read_scripts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.groovy").write_text(GROOVY)
    (tmp_path / "w.xml").write_text('<workflow name="W"><action id="1" name="T"><function type="x"/></action></workflow>')
    rows = {r.filename: r.content for r in io.read_scripts(spark, str(tmp_path)).collect()}
    assert rows["a.groovy"] == GROOVY and io.read_workflow_exports(spark, str(tmp_path)).count() == 1


def test_page_text_and_title(spark):
    html = "<html><head><title>Doc &amp; more | Atlassian Developer site</title></head><body><h1>Top</h1><h2 class='x'>Sub <b>bold</b></h2><p>One&nbsp;two &lt;x&gt; &amp;lt;</p><ul><li>a</li><li>b</li></ul><pre><code>let x = 1;\n\n\n\nend</code></pre></body></html>"
    df = spark.createDataFrame([(html,), ("<h1>Only</h1>",), ("",)], "html string")
    rows = [tuple(r) for r in df.select(tx.page_title(F.col("html")), tx.page_text(F.col("html"))).collect()]
    assert rows[0][0] == "Doc &amp; more" and rows[1] == ("Only", "# Only") and rows[2] == ("Untitled", "")
    text = rows[0][1]
    assert "## Sub bold" in text and "One two <x> <" in text and "- a\n- b" in text and "```\nlet x = 1;\n\nend\n```" in text


def chunks_by_hand(text, most, overlap, sep="\n\n"):
    import math
    import re

    tokens = lambda s: math.ceil(len(s) / 4)
    out = []
    for section in re.split(r"(?=\n#{1,4}\s)", text):
        section = section.strip()
        if not section:
            continue
        if tokens(section) <= most:
            out.append(section)
            continue
        current, code = "", False
        for para in re.split(r"\n\n+", section):
            code ^= "```" in para
            joined = f"{current}{sep}{para}" if current else para
            if tokens(joined) <= most or code:
                current = joined
            else:
                if current:
                    out.append(current.strip())
                current = para
        if current.strip():
            out.append(current.strip())
    return [c if k == 0 else f"{out[k - 1][-4 * overlap:]}\n\n{c}".strip() for k, c in enumerate(out)]


def test_chunks(spark):
    para = lambda w, n: " ".join([w] * n)
    texts = [
        "\n\n".join(para(f"w{k}", 30) for k in range(12)),
        "# A\nshort\n## B\n" + "\n\n".join(para("x", 40) for _ in range(6)),
        "start\n\n```\ncode\n\n" + para("in", 200) + "\n\n```\n\nafter " + para("z", 100),
        "", "tiny", para("huge", 500),
    ]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "url string, text string")
    got = {}
    for r in index.chunk_documents(df, 50, 5).orderBy("url", "chunk_index").collect():
        got.setdefault(r.url, []).append(r.content)
    assert got == {str(k): c for k, t in enumerate(texts) if (c := chunks_by_hand(t, 50, 5))}
    table = index.chunk_table(df, 50, 5)
    assert table.count() == table.select("chunk_id").distinct().count()


@pytest.mark.parametrize("sep", ["\n\n", "\n"])
def test_linear_cut_equals_the_fold(spark, sf, sep):
    from estatelens.operators.chunker import cut, cut_documents

    odd = ["", "  \n ", None, "a\n\n\n\nb", "\n\n" + "x" * 300, "```\n\n" + "y " * 300, "# H\n" + "z " * 200 + "\n## I\n\n\n" + "\n\n".join("w " * 40 for _ in range(9)), "\n# A\n# B", "é𝒳 " * 200]
    given = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("url"), "text")
    docs = given.unionByName(spark.createDataFrame([(f"odd{k}", t) for k, t in enumerate(odd)], "url string, text string"))
    told = lambda df: sorted(map(str, df.collect()))
    for most, overlap in ((50, 5), (7, 1)):
        assert told(cut_documents(docs, most, overlap, sep)) == told(index.chunk_documents(docs, most, overlap, sep))
    at = time.process_time()
    assert len(cut("\n\n".join("word " * 30 for _ in range(140_000)), 500, 50, "\n\n")) > 5000  # 21 MB
    assert time.process_time() - at < 10


def snapshot(spark, rows, at):
    return spark.createDataFrame(rows, "url string, html string, status int").withColumn("crawled_at", F.to_timestamp(F.lit(at)))


def test_refresh_is_idempotent_and_keeps_vectors_of_unchanged_text(spark, tmp_path):
    def embed(texts):
        return texts.map(lambda t: [float(len(t)), 1.0])

    empty = spark.createDataFrame([], "chunk_id string, url string, chunk_index int, content string, content_hash string, crawled_at timestamp, created_at timestamp, embedding array<float>")
    long = "<p>" + "</p><p>".join(f"{w} " * 300 for w in ("one", "two", "three", "four")) + "</p>"
    first = snapshot(spark, [("u1", long, 200), ("u2", "<p>stays</p>", 200), ("u3", "<p>bad</p>", 500)], "2024-01-01 00:00:00")
    none = index.page_table(first).limit(0)
    v1, report = index.refresh(empty, none, first, "2024-01-01 00:00:00", embed)
    io.write_snapshot(v1, str(tmp_path / "v1"))
    v1 = spark.read.parquet(str(tmp_path / "v1"))
    r = report.first()
    assert (r.attempted, r.succeeded, r.failed, r.skipped) == (3, 2, 1, 0) and v1.where("embedding IS NULL").isEmpty() and v1.where("url = 'u1'").count() > 1
    pages = index.page_table(first)
    again, report = index.refresh(v1, pages, first, "2024-01-01 00:00:00", embed)
    assert report.first().skipped == 2 and sorted(map(str, again.select(v1.columns).collect())) == sorted(map(str, v1.collect()))
    second = snapshot(spark, [("u1", "<p>short now</p>", 200), ("u2", "<p>stays</p>", 200)], "2024-02-20 00:00:00")
    v2, _ = index.refresh(v1, pages, second, "2024-03-05 00:00:00")
    rows = {(r.url, r.chunk_index): r for r in v2.collect()}
    assert set(rows) == {("u1", 0), ("u2", 0)}  # orphans are gone, what was seen again does not expire
    assert rows["u1", 0].embedding is None and rows["u2", 0].embedding is not None and str(rows["u1", 0].created_at).startswith("2024-01-01")
    late, _ = index.refresh(v1, pages, second.where("url = 'u1'"), "2024-03-05 00:00:00")
    assert {r.url for r in late.collect()} == {"u1"}
    # a page that has become empty loses its chunks
    third = snapshot(spark, [("u1", "", 200), ("u2", "<p>stays</p>", 200)], "2024-01-09 00:00:00")
    v3, report = index.refresh(v1, pages, third, "2024-01-10 00:00:00", embed)
    assert {r.url for r in v3.collect()} == {"u2"}
    r = report.first()
    assert (r.skipped, r.chunks_created, r.chunks_skipped, r.chunks_embedded) == (1, 0, 1, 0)


def events(spark, rows):
    return spark.createDataFrame(rows, "seq long, session_id string, kind string, server_id string, op string, cloud_id string, notes string")


EVENTS = [(1, "s", "user", "bob", "map", "c1", "n1"), (2, "s", "user", "bob", "skip", None, None), (3, "s", "field", "f", "skip", None, "why"), (4, "s", "field", "f", "map", "c2", None)]


def test_mapping_state_in_any_order(spark):
    want = {("user", "bob"): ("skipped", "c1", "n1", "remove"), ("field", "f"): ("mapped", "c2", "why", None)}
    for rows in (EVENTS, EVENTS[::-1], EVENTS + EVENTS):
        assert {(r.kind, r.server_id): (r.status, r.cloud_id, r.notes, r.strategy) for r in mappings.mapping_state(events(spark, rows)).collect()} == want


def test_bootstrap_takes_the_first_place_and_the_last_usage(spark):
    content = "x customfield_10001\ny.setValue(customfield_10001 )"
    df = spark.createDataFrame([(1, "a.groovy", content)], "script_id long, filename string, content string")
    r = mappings.bootstrap(findings.scan(df)).first()
    assert (r.first_line, r.usage, r.status) == (1, "write", "unmapped")


def test_sessions_round_trip(spark):
    state = mappings.mapping_state(events(spark, EVENTS))
    docs = io.export_sessions(state)
    bad = spark.createDataFrame([("s2", "{broken"), ("s3", '{"mappings": []}')], "session_id string, json string")
    back, rejected = io.import_sessions(docs.unionByName(bad), "2024-01-01 00:00:00")
    assert {(r.kind, r.status, str(r.expires_at)) for r in back.collect()} == {("user", "skipped", "2024-01-02 00:00:00"), ("field", "mapped", "2024-01-02 00:00:00")}
    assert rejected.count() == 2


def test_templates(spark):
    code = 'a = ATLAS_FIELD_ID("customfield_10001"); b = ATLAS_ACCOUNT_ID( \'bob\' ); c = ATLAS_GROUP_ID("g"); d = ATLAS_FIELD_ID("customfield_10001")'
    files = spark.createDataFrame([(1, "f.ts", code), (2, "g.ts", "plain"), (3, "h.ts", "")], "job_id long, filename string, content string")
    maps = spark.createDataFrame([("field", "customfield_10001", "customfield_9", "mapped", None, None), ("user", "bob", "x", "skipped", "gone", "remove")], "kind string, server_id string, cloud_id string, status string, notes string, strategy string")
    got = {r.job_id: r.content for r in templates.resolve(files, maps).collect()}
    assert got == {1: 'a = "customfield_9"; b = /* USER REMOVED: bob — gone */ null; c = ATLAS_GROUP_ID("g"); d = "customfield_9"', 2: "plain", 3: ""}
    r = templates.resolution_stats(files, maps).where("job_id = 1").first()
    assert (r.total, r.resolved, r.unresolved, r.distinct_unresolved) == (4, 3, 1, 1)


def test_lint(spark):
    files = spark.createDataFrame([(1, "a.ts", "x.getUsername( )\nfetch('/rest/api/2/x')\nnew File(\"x\")"), (1, "manifest.yml", "app:\npermissions:\nmodules:"), (2, "a.ts", "ok")], "job_id long, filename string, content string")
    assert {(r.line_no, r.code) for r in lint.lint(files).collect()} == {(1, "VAL_011"), (2, "VAL_020"), (3, "VAL_005")}
    assert lint.fixed_files(files).where("filename = 'a.ts' AND job_id = 1").first().content == "x.accountId\nfetch('/rest/api/3/x')\nnew File(\"x\")"
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id long")
    got = {r.job_id: (r.passed, r.n_errors, r.n_fixed) for r in lint.verdicts(jobs, files).collect()}
    assert got == {1: (False, 1, 2), 2: (False, 1, 0), 3: (False, 1, 0)}


def test_raw_ids_in_both_spellings(spark):
    lines = ['f("customfield_10001")', 'ATLAS_FIELD_ID("customfield_10001")', "customfield_1000)", "customfield_10001)", "x"]
    files = spark.createDataFrame([(1, "a.ts", "\n".join(lines))], "job_id long, filename string, content string")
    found = lambda strict: {r.line_no for r in lint.lint(files, strict).where("code = 'VAL_040'").collect()}
    assert found(True) == {1, 2, 4} and found(False) == {1, 3, 4} and found(None) == {1, 2, 3, 4}


def test_auto_map_equals_the_nested_loop(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abAB ", k=rng.randint(0, 6)))
    names = [(k, word()) for k in range(120)] + [(200, None), (201, ""), (202, "ünï x"), (203, "zz")]
    cat = [(k, f"cf_{k}", word()) for k in range(60)] + [(70, "cf_70", "Ünï"), (71, "cf_71", None), (72, "other_1", "zz")]
    for entries in (cat, [c for c in cat if (c[2] or "x").strip()], []):
        got = mappings.auto_map(spark.createDataFrame(names, "server_id long, server_name string"), spark.createDataFrame(entries, "ord int, cloud_id string, name string"), "cf_").collect()
        own = [c for c in entries if c[1].startswith("cf_")]
        want = set()
        for i, n in names:
            key = n.strip(" ").lower() if n is not None else None
            exact = [c for c in own if key is not None and c[2] is not None and c[2].strip(" ").lower() == key]
            near = [c for c in own if key is not None and c[2] is not None and (key in c[2].lower() or c[2].lower() in key)]
            best = min(exact or near, default=(0, None, None))
            want.add((i, n, best[1], best[2], "exact" if exact else "fuzzy" if near else "none"))
        assert {tuple(r) for r in got} == want and len(got) == len(names)


def test_auto_map_has_no_nested_loop(spark):
    names = spark.createDataFrame([(1, "a")], "server_id long, server_name string")
    cat = spark.createDataFrame([(1, "cf_1", "b")], "ord int, cloud_id string, name string")
    plan = mappings.containing(names.select(F.col("server_name").alias("needle")), cat.select(F.col("name").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_targets(spark, tmp_path):
    good = [(f"https://x/{k}", "forge-api", "high", "weekly") for k in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "url string, category string, priority string, frequency string")
    assert set(targets.write_targets(frame(good), str(tmp_path / "a")).values()) == {0} and targets.accepted(spark, str(tmp_path / "a")).count() == 20
    bad = [*good[:3], good[0], ("http://y", "blog", "urgent", None), (None, None, None, None)]
    told = targets.write_targets(frame(bad), str(tmp_path / "b"))
    assert told == {"too-few": 1, "duplicate-url": 1, "not-https": 2, "unknown-category": 2, "unknown-priority": 2, "unknown-frequency": 2}
    assert targets.violations(spark, str(tmp_path / "b")).count() == 9 and targets.accepted(spark, str(tmp_path / "b")).count() == 3
    assert targets.write_targets(frame([]), str(tmp_path / "c"))["too-few"] == 1


def test_quantiles_from_sketches(spark):
    rows = spark.range(200_000).select(F.expr("'s' || id % 2").alias("stage"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 10).alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1000.0).alias("ms"))
    sketches = telemetry.stage_sketches(rows.unionByName(rows.limit(5).withColumn("ms", F.lit(None).cast("double"))))
    for since, until in (("2024-01-01 00:00:00", "2024-02-01 00:00:00"), ("2024-01-03 05:00:00", "2024-01-03 09:00:00")):
        for r in telemetry.window_quantiles(sketches, since, until).collect():
            own = rows.where((F.col("stage") == r.stage) & (F.col("ts") >= since) & (F.col("ts") < until))
            assert r.n == own.count() and abs(own.where(F.col("ms") <= r.quantile_ms).count() / r.n - 0.95) < 0.01


def test_retrieval(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    docs = spark.createDataFrame([(k, x.tolist(), f"c{k % 3}") for k, x in enumerate(v)] + [(900, None, "c0")], "doc_id long, vector array<double>, category string")
    asked = docs.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit[:5] @ unit.T, 6)
    want = {(q, d) for q in range(5) for d in sorted(range(200), key=lambda d: (-sims[q, d], d))[:4] if sims[q, d] >= 0.3}
    got = retrieval.cosine_topk(asked, docs, 4, 0.3)
    assert {(r.query_id, r.doc_id) for r in got.collect()} == want


def test_keyword_terms_of_every_length(spark):
    texts = ["a bc def", "Abcdef", "xx", None, "", "the CAT sat", "concatenate"]
    asks = [(0, "a"), (1, "bc cat"), (2, "def xx zzz"), (3, "  "), (4, "cat CAT")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.query_id, r.doc_id, r.similarity) for r in retrieval.keyword_topk(spark.createDataFrame(asks, "query_id long, text string"), docs, 9).collect()}
    want = set()
    for q, ask in asks:
        terms = set(ask.lower().split())
        want |= {(q, d, round(sum(t in (x or "").lower() for t in terms) / len(terms), 6)) for d, x in enumerate(texts) if any(t in (x or "").lower() for t in terms)}
    assert got == want


@pytest.mark.parametrize("batch", [10_000, 64])
def test_equal_vectors_are_taken_in_order_of_id(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rows = [((k * 389) % 1000, [1.0, 1e-8 * (k % 3), 0.0], f"c{k % 2}") for k in range(1000)] + [(2000 + k, [1.0, 1.0, float(k)], "c0") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>, category string").coalesce(1)
    asked = spark.createDataFrame([(7, [2.0, 0.0, 0.0], "c1")], "query_id long, vector array<double>, category string")
    try:
        for by_category in (False, True):
            ids = sorted(d for d, _, c in rows if d < 1000 and (c == "c1" or not by_category))[:4]
            got = retrieval.cosine_topk(asked, docs, 4, 0.2, by_category=by_category).orderBy("rank").collect()
            assert [(r.doc_id, r.similarity) for r in got] == [(d, 1.0) for d in ids]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_texts(spark):
    job = spark.createDataFrame([(1, "forge-native", "validator", True, True, True)], "job_id long, target string, module string, needs_users boolean, needs_fields boolean, has_http boolean")
    rows = retrieval.build_queries(job).orderBy("ord").collect()
    assert len(rows) == 6 and rows[0].query == "Atlassian Forge validator implementation requestJira" and rows[5].query.endswith("manifest.yml permissions")


def test_telemetry(spark):
    use = spark.createDataFrame([(1, "gpt-4o-mini", "cheap", 1_000_000), (1, "unknown", "expensive", 1000)], "job_id long, model string, tier string, tokens long")
    assert telemetry.cost_rollup(use).first().cost == 0.153
    maps = spark.createDataFrame([(1, {"s1": 5, "s2": 7})], "job_id long, timings map<string,long>")
    assert telemetry.timings_of_maps(maps).count() == 2


def test_workflow_scripts_and_warnings(spark):
    def action(name, functions):
        return f'<action id="1" name="{name}"><results><result old-status="Open" status="Done"/></results>{functions}</action>'

    def function(type_, args):
        return f'<function type="{type_}">{args}</function>'

    groovy = "com.onresolve.jira.groovy.GroovyFunctionPlugin"
    xml = '<workflow name="My Flow!">' + action("Go &amp; do", function(groovy, '<arg name="script"><![CDATA[a < b]]></arg>') + function(groovy, '<arg name="groovy.script">c &lt; d</arg>') + function("com.x.MyGroovyThing", "") + function(groovy, '<arg name="FIELD_FUNCTION_ID">77</arg>')) + "</workflow>"
    df = spark.createDataFrame([(1, xml), (2, '<workflow name="e"></workflow>'), (3, '<workflow name="n">' + action("T", function("com.other.Plain", "")) + "</workflow>")], "workflow_id long, xml string")
    rows = workflow.scripts(df).orderBy("script_index").collect()
    assert [(r.script, r.script_index, r.total_scripts, r.from_status, r.to_status) for r in rows] == [("a < b", 0, 2, "Open", "Done"), ("c < d", 1, 2, "Open", "Done")]
    assert {(r.workflow_id, r.warning) for r in workflow.warnings(df).collect()} == {(1, "unknown-type"), (1, "external-file"), (2, "no-actions"), (3, "no-scripts")}


def test_xml_entities(spark):
    rows = ["a &amp;lt; b", "&#38;#65;", "&#65;&#8364;&#65;", "&lt;x&gt; &quot;&apos;", "&#65601;", "plain", ""]
    got = [r.d for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(workflow.decoded(F.col("t")).alias("d")).collect()]
    assert got == ["a < b", "&#65;", "A€A", "<x> \"'", "A", "plain", ""]
    groovy = "com.onresolve.jira.groovy.GroovyFunctionPlugin"
    xml = f'<workflow name="w"><action name="a"><function type="{groovy}"><arg name="script">\n <![CDATA[  x &lt; &#66;  ]]> </arg></function></action></workflow>'
    assert workflow.scripts(spark.createDataFrame([(1, xml)], "workflow_id long, xml string")).first().script == "x < B"


def test_every_class_has_an_alternative_and_every_rule_shows_something():
    assert {c for _, c, _ in packs.DEPRECATED} == set(packs.ALTERNATIVES)
    assert {c for c, *_ in packs.READINESS} == set(packs.EVIDENCE)


def test_evidence(spark):
    script = "def f = new File('a')\ndef g = new FileWriter('b')\ndef u = userManager.getUserByName('bob')\nUnirest.get('/rest/api/2/issue/A')\nUnirest.get('/rest/api/2/user/B')\nx = 'customfield_10001' + 'customfield_10001'"
    rows = readiness.issues(readiness.profile(spark.createDataFrame([(1, "a.txt", script)], "script_id long, filename string, content string"), evidence=True)).collect()
    got = {r.code: (r.first_line, r.affected) for r in rows}
    assert got["CR-001"] == (1, "java.io.File, java.io.FileWriter") and got["CR-010"] == (3, "bob, bob")
    assert got["CR-012"] == (6, "customfield_10001") and got["CR-015"] == (4, "/rest/api/2/issue/A, /rest/api/2/user/B")


def test_every_rule_is_met_by_the_derived_estate(spark):
    from estatelens.sources.estate import table

    d = "/root/testdata/sf0.01"
    scripts = table(spark, d, "scripts")
    rows = readiness.profile(scripts, evidence=True)
    rows.write.mode("overwrite").format("noop").save()  # the whole of it can be worked out
    values = lambda df, *c: {tuple(r) if len(c) > 1 else r[0] for r in df.select(*c).distinct().collect()}
    assert {c for c, *_ in packs.READINESS} <= values(readiness.issues(rows), "code")
    assert set(packs.MODULES) <= values(rows, "module") and set(packs.TRIGGERS) <= values(rows, "trigger")
    assert {(f, k) for f, rules in packs.FAMILIES.items() for k in range(1, len(rules) + 1)} == values(findings.findings(scripts), "family", "rule_ord")
    assert len(values(readiness.suitability(rows), "rationale")) == 7
    labels = {label for _, label, _ in packs.MAPPABLE} | {label for _, label in packs.UNMAPPABLE}
    assert labels == values(classify.automation_operations(scripts), "label")
    assert {t for _, t in packs.TARGETS} <= values(readiness.verdicts(scripts), "target")
    assert {c for c, *_ in packs.LINT} == values(lint.lint(table(spark, d, "generated_files")), "code")
    assert findings.script_edges(findings.findings(scripts, ["script_dep"]), scripts).where("target_script_id IS NOT NULL").count() > 0


def test_tasks_of_workflow_exports_follow_the_orders(spark, sf, monkeypatch):
    from estatelens.sources import estate

    monkeypatch.setattr(estate, "EXPORT_ROWS", 50)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    plan = estate.table(spark, sf, "workflow_exports")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o_custkey" in plan and f", {-(-n // 50)})" in plan.replace(", REPARTITION_BY_NUM", ")")
