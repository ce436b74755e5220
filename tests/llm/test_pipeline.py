"""The pipeline and the registered queries over the smallest tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from estatelens.llm.common import materialize, read
from estatelens.llm.queries import QUERIES

from .test_operators import odd_documents


def test_queries_are_registered_and_run(spark, sf):
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    n = read(spark, sf, "documents").count()
    for name in ("op4_secret_scan", "op5_toxicity", "op8_source_mixing", "op9_quality_classifier"):
        assert QUERIES[name](spark, sf).count() == n


def test_stages_in_turn(spark, sf):
    docs = read(spark, sf, "documents")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            seen.append(docs.count())
    assert seen[1] <= seen[0] and seen[2] <= seen[1] and seen[2] == seen[3] == seen[4]
    rows = docs.collect()
    assert len({r["doc_id"] for r in rows}) == seen[4]
    assert all(np.frombuffer(r["ids"], "<u4").size == r["length"] <= 4096 for r in rows)


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_takes_odd_and_empty_documents(spark, sf, empty):
    docs = spark.createDataFrame(odd_documents(spark, empty=empty).collect(), odd_documents(spark).schema)
    docs = materialize(docs, "docs")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.schema.simpleString() == docs.schema.simpleString()
        ids = [r["doc_id"] for r in out.collect()]
        if empty:
            assert not ids
        elif k == 1:
            assert None in ids and len(ids) < n and len(set(ids)) == len(ids)
        elif k in (0, 3):
            assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))  # nothing toxic among them, and nothing lost or changed
        elif k == 2:
            told = lambda rows: Counter(tuple(r) for r in rows if r["doc_id"] != 10)
            assert told(out.collect()) == told(docs.collect()) and len(ids) == n
            assert [r["text"] for r in out.where("doc_id = 10").collect()] == ["[SECRET] and more"]
        else:
            assert set(ids) == {r["doc_id"] for r in docs.collect()} and len(ids) >= n


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs = read(spark, sf, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    labels = read(spark, sf, "labels").join(docs.select("doc_id"), "doc_id").where("toxic IS NOT NULL").select("doc_id", "toxic").collect()
    toxic, clean = ({r["doc_id"] for r in labels if r["toxic"] == y} for y in (1, 0))
    assert len(toxic - kept) >= 0.9 * len(toxic) and len(clean & kept) >= 0.98 * len(clean)


def test_the_order_of_the_mix_reaches_the_sequences(spark, tmp_path):
    """The same rows stored in two orders: pieces of a length, and the sequences, follow the order they are stored in."""
    ids = [(k * 389) % 400 for k in range(400)]
    schema = "at long, doc_id long, text string, source string"
    words = "plain river letters under the stone garden " * 150
    for name, order in (("up", sorted(ids)), ("mixed", ids)):
        told = {d: k for k, d in enumerate(order)}
        docs = spark.createDataFrame([(k, d, words[: 700 + 90 * (d % 4)] * 4, "s") for k, d in enumerate(order)], schema)
        docs.repartitionByRange(7, "at").sortWithinPartitions("at").drop("at").write.parquet(str(tmp_path / name))
        got = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / name)), "").collect()
        assert sorted(r["doc_id"] for r in got) == sorted(ids) and len({(r["sequence_id"], r["offset"]) for r in got}) == 400
        held = {}
        for r in got:
            held.setdefault(r["sequence_id"], []).append(r)
        firsts = [min(told[r["doc_id"]] for r in held[s]) for s in range(len(held))]
        assert firsts == sorted(firsts)
        # pieces of a length that share a sequence stand near one another in the order
        for own in held.values():
            for n in {r["length"] for r in own}:
                turns = [told[r["doc_id"]] for r in own if r["length"] == n]
                assert max(turns) - min(turns) <= 60
    docs = spark.createDataFrame([(d, "one two", "s") for d in ids], "doc_id long, text string, source string")
    inorder = [r["doc_id"] for r in corpus_pipeline.pack(spark, docs, "").orderBy("sequence_id", "offset").collect()]
    assert inorder == [r["doc_id"] for r in docs.collect()]
