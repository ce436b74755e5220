"""Exact search in two rounds and the stored index, against brute force."""

import numpy as np
import pytest

from estatelens.operators import retrieval
from estatelens.operators.vector_index import VectorIndex


def brute(asked, docs, k, threshold, by_category=False):
    """Best ids by similarity rounded to six places, then id; vectors of other widths do not meet."""
    out = set()
    for q, v, c in asked:
        scored = []
        for d, w, e in docs:
            if v is None or w is None or len(v) != len(w) or not v or (by_category and (c is None or c != e)):
                continue
            if any(x is None or not np.isfinite(x) for x in [*v, *w]):
                continue
            a, b = (np.array(x, float) / max(1e-300, *map(abs, x), 0.0) for x in (v, w))  # no overflow
            size = np.linalg.norm(a) * np.linalg.norm(b)
            s = round(float(a @ b / size), 6) if size else 0.0
            if s >= threshold:
                scored.append((-s, d))
        out |= {(q, d, -s, r) for r, (s, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def told(df):
    return {(r.query_id, r.doc_id, r.similarity, r["rank"]) for r in df.collect()}


def near(got, want):
    assert {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in want}


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 6
    return [(k, (centres[k % 12] + rng.normal(size=width)).tolist(), f"c{k % 2}") for k in range(n)]


SCHEMA = "doc_id long, vector array<double>, category string"


@pytest.mark.parametrize("by_category", [False, True])
@pytest.mark.parametrize("group_bytes", [1 << 25, 8000, 700])
def test_two_rounds_equal_brute_force(spark, group_bytes, by_category):
    rows = clustered(300, 8, 1)
    rows += [(1000 + (k * 7) % 90, rows[5][1], "c1") for k in range(90)]  # copies: ties are settled by id
    rows += [(2000 + k, x, "c0") for k, x in enumerate([None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 3, [0.0, 1.0, 0.0], [1.0], [2.0], [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1e300] * 8])]
    rows += [(3000, rows[0][1], None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] >= 2000]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>, category string")
    for k, threshold in ((4, 0.3), (100, -1.0)):
        near(told(retrieval.cosine_topk(queries, docs, k, threshold, by_category, group_bytes)), brute(asked, rows, k, threshold, by_category))


def test_vectors_of_other_widths_never_meet(spark):
    rows = [(1, [1.0], "c"), (2, [0.0, 1.0, 0.0], "c"), (3, [1.0, 0.0], "c"), (4, [0.0, 2.0, 0.0], "c")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert told(retrieval.cosine_topk(docs.withColumnRenamed("doc_id", "query_id"), docs, 4, 0.2)) == {(1, 1, 1.0, 1), (2, 2, 1.0, 1), (2, 4, 1.0, 2), (4, 2, 1.0, 1), (4, 4, 1.0, 2), (3, 3, 1.0, 1)}


def test_far_cells_are_skipped(spark):
    rows = clustered(1200, 16, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    queries = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    visited = []
    got = told(retrieval.cosine_topk(queries, docs, 4, -1.0, group_bytes=8000, visited=visited))
    near(got, brute([r for r in rows if r[0] % 100 == 0], rows, 4, -1.0))
    cells = 12 * min(retrieval.MOST_CELLS, -(-1200 * 16 * 8 // 8000))
    assert sum(v.count() for v in visited) < 0.5 * cells


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0], "c")], SCHEMA)
    for a, b in ((none, some), (some, none), (none, none)):
        assert retrieval.cosine_topk(a.withColumnRenamed("doc_id", "query_id"), b, 4, 0.2).count() == 0


# --- the stored index


def recall(spark, index, queries, docs, k=4, **more):
    exact = retrieval.cosine_topk(queries, docs, k, -1.0).select("query_id", "doc_id")
    found = retrieval.ann_topk(queries, index, k, **more).select("query_id", "doc_id")
    return found.join(exact, ["query_id", "doc_id"], "left_semi").count() / exact.count()


def test_recall_on_clusters_with_a_quarter_of_the_cells(spark, tmp_path):
    rows = clustered(2400, 12, 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    built = VectorIndex.build(docs, str(tmp_path / "ivf"), cells=16, parts=6, words=64)
    opened = VectorIndex.open(spark, str(tmp_path / "ivf"))
    assert np.allclose(built.centres, opened.centres) and built.counts == opened.counts and sum(built.counts.values()) == 2400
    queries = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    assert recall(spark, opened, queries, docs, probes=4) >= 0.9
    one = queries.limit(1)
    retrieval.ann_topk(one, opened, 4, probes=2).collect()
    assert opened.probed["cells"] == 2 and opened.probed["rows"] < opened.probed["of_rows"] / 2


def test_a_search_reads_the_probed_cells_only(spark, tmp_path):
    docs = spark.createDataFrame(clustered(600, 8, 4), SCHEMA)
    index = VectorIndex.build(docs, str(tmp_path / "ivf"), cells=8, parts=4, words=32)
    one = docs.limit(1).withColumnRenamed("doc_id", "query_id")
    plan = index.candidates(one, 1, 40)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(cell#" in plan and "PartitionFilters: []" not in plan and "ReadSchema: struct<doc_id:bigint,slice:int,code:binary>" in plan
    files = sum(1 for _ in (tmp_path / "ivf" / "codes").rglob("*.parquet"))
    assert files >= 8


def test_recall_on_the_given_vectors(spark, sf):
    from estatelens.plans.queries import QUERIES, _query_sides

    asked, docs = _query_sides(spark, sf)
    exact = retrieval.cosine_topk(asked, docs, 4, -1.0)
    hits = QUERIES["ann_topk"](spark, sf).join(exact.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").count()
    assert hits >= 0.9 * exact.count()


def test_hot_cells_copies_and_odd_rows(spark, tmp_path, monkeypatch):
    from estatelens.operators import vector_index

    monkeypatch.setattr(vector_index, "SLICE_ROWS", 50)
    rows = [((k * 389) % 1000, [1.0, 0.5, 0.0, 0.0], "c") for k in range(1000)] + [(5000 + k, [0.0, 0.0, 1.0, float(k)], "c") for k in range(20)]
    rows += [(9000, None, "c"), (9001, [1.0], "c"), (9002, [float("nan")] * 4, "c"), (9003, [0.0] * 4, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex.build(docs, str(tmp_path / "ivf"), cells=4, parts=2, words=8)
    asked = spark.createDataFrame([(7, [2.0, 1.0, 0.0, 0.0]), (8, None), (9, [1.0])], "query_id long, vector array<double>")
    got = retrieval.ann_topk(asked, index, 4, probes=4).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(7, 0), (7, 1), (7, 2), (7, 3)]
    none = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert retrieval.ann_topk(asked, none, 4).count() == 0


def test_candidates_come_in_blocks_without_the_queries_vectors(spark, tmp_path, monkeypatch):
    from estatelens.operators import vector_index

    docs = spark.createDataFrame(clustered(600, 8, 4), SCHEMA)
    index = VectorIndex.build(docs, str(tmp_path / "ivf"), cells=4, parts=4, words=32)
    asked = docs.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    found = lambda: sorted(map(tuple, retrieval.ann_topk(asked, index, 4, probes=4).collect()))
    whole = found()
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 20)
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 100)
    assert index.candidates(asked, 4, 16).columns == ["query_id", "doc_id", "cell", "estimate"]
    assert len({r[0] for r in whole}) == asked.count() and [r[:2] for r in found()] == [r[:2] for r in whole]
