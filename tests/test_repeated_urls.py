"""A url that a snapshot has twice stands for one page: the latest, the first of equally late ones."""

from collections import Counter

import duckdb
import pytest

from estatelens.operators import index
from estatelens.plans import queries

COLUMNS = "page_id long, url string, html string, status int, crawled_at string"


def snapshot(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("crawled_at", index.F.col("crawled_at").cast("timestamp"))


def test_the_first_of_equally_late_rows_counts(spark):
    rows = [(k, "u", f"<p>text {k}</p>", 200, "2024-01-01") for k in range(8, 0, -1)]
    assert index.latest_per_url(index.page_table(snapshot(spark, rows))).first()["text"] == "text 1"


def test_a_url_stored_twice_does_not_double_its_page(spark):
    first = snapshot(spark, [(1, "u", "<p>one</p>", 200, "2024-01-01"), (2, "u", "<p>two</p>", 200, "2024-01-01"), (3, "v", "<p>three</p>", 200, "2024-01-01")])
    second = snapshot(spark, [(1, "u", "<p>new</p>", 200, "2024-01-02"), (3, "v", "<p>three</p>", 200, "2024-01-02")])
    pages = index.page_table(first)
    empty = spark.createDataFrame([], "chunk_id string, url string, chunk_index int, content string, content_hash string, crawled_at timestamp, created_at timestamp, embedding array<float>")
    chunks, _ = index.refresh(empty, pages.limit(0), first, "2024-01-01 00:00:00")
    again, report = index.refresh(chunks, pages, second, "2024-01-02 00:00:00")
    told = report.first()
    assert (told["chunks_created"], told["skipped"], told["chunks_skipped"]) == (1, 1, 1)
    assert sorted(r["content"] for r in again.collect()) == ["new", "three"]


@pytest.mark.parametrize("name", ["chunk_merge", "stale_and_orphans"])
def test_a_shared_url_has_one_row_for_each_chunk(spark, tmp_path, name):
    long = lambda word, n: f"<h1>{word}</h1>" + "".join(f"<p>{word} {k} {'text ' * 60}</p>" for k in range(n))
    rows = [(2, "u", long("two", 5)), (3, "v", long("three", 4)), (6, "w", long("six", 3)), (12, "u", long("twelve", 9)), (22, "x", long("later", 2)), (None, "y", long("none", 3))]
    found = {}
    for kind, kept in {"shared": rows, "copied": [*rows, *rows], "single": [r for r in rows if r[0] != 12]}.items():
        spark.createDataFrame(kept, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / kind / "pages.parquet"))
        found[kind] = Counter(map(tuple, queries.QUERIES[name](spark, str(tmp_path / kind)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/single/pages.parquet/*.parquet'")
    assert found["single"] == Counter(con.execute(queries.ORACLES[name]).fetchall())
    assert found["shared"] == found["copied"] == found["single"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_text_of_a_page_is_worked_out_once(spark):
    rows = [(1, "u", "<h1>a <b>b</b></h1><pre>x</pre><h2>c</h2><p>d</p><h4> e</h4>", 200, "2024-01-01"), (2, "v", None, 200, "2024-01-01")]
    pages = index.page_table(snapshot(spark, rows))
    told = plan_of(pages)
    assert [told.count(f"(?i)<h{level}[^>]*>.*?</h{level}>") for level in range(1, 5)] == [1] * 4 and told.count("(?is)<pre[^>]*>.*?</pre>") == 1
    assert {r["url"]: r["text"] for r in pages.collect()} == {"u": "# a b\n\n```\nx\n```\n\n## c\nd\n\n#### e", "v": None}
    empty = spark.createDataFrame([], queries.NO_CHUNKS)
    chunks, report = index.refresh(empty, pages.limit(0), snapshot(spark, rows), "2024-01-01 00:00:00")
    assert not any("<pre" in plan_of(df) for df in (chunks, report))
