"""What queries make of a text stays where the text is."""

import re

from estatelens.operators import retrieval


def test_no_shuffle_of_pairs_of_query_and_text(spark):
    asked = spark.createDataFrame([(k, "the cat sat on") for k in range(5)], "query_id long, text string")
    docs = spark.createDataFrame([(k, "the cat" if k % 2 else "sat") for k in range(20)], "doc_id long, text string")
    best = retrieval.keyword_topk(asked, docs, 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L, doc_id#\d+L", plan) and re.search(r"hashpartitioning\(doc_id#\d+L, \d", plan)
    assert sorted(map(tuple, best.where("query_id = 0").collect())) == [(0, 1, 0.5, 1), (0, 3, 0.5, 2)]
