"""The toxicity grammar: composition against one transducer after the other, clauses, edges, recall on held-out labels."""

import functools
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelens.llm import toxicity
from estatelens.llm.common import read
from estatelens.llm.labels import remainder
from estatelens.llm.queries import QUERIES

from .test_operators import odd_documents


def one_after_the_other(symbols):
    out = [(s, 0.0) for s in symbols]
    for stage in toxicity.STAGES:
        out = [(w, a + b) for (w, b), (_, a) in zip(stage.run([s for s, _ in out]), out, strict=True)]
    return out


@given(st.lists(st.sampled_from(toxicity.SYMBOLS), max_size=30))
@settings(max_examples=300, deadline=None)
def test_composition_writes_what_the_stages_write_in_turn(symbols):
    assert toxicity.AUTOMATON.run(symbols) == one_after_the_other(symbols)


def test_all_short_paths():
    for path in itertools.product(toxicity.SYMBOLS, repeat=4):
        assert toxicity.AUTOMATON.run(path) == one_after_the_other(path)


def test_composition_is_associative():
    compose = lambda a, b: toxicity.compose(a, b, toxicity.SYMBOLS)
    a, b, c, d = toxicity.STAGES
    written = {w for x in (functools.reduce(compose, (a, b)),) for _, w, _ in x.arcs.values()} | set(toxicity.SYMBOLS)
    right = compose(compose(a, b), toxicity.compose(c, d, sorted(written)))
    for path in itertools.product(toxicity.SYMBOLS, repeat=3):
        assert right.run(path) == toxicity.AUTOMATON.run(path)


@pytest.mark.parametrize("text, kind", [
    ("you are a foolio", "insult at target"), ("a foolio", "insult"), ("a foolio, you are", "insult at target"), ("you are not a foolio", "negated insult"),
    ("you are not, my friend, a foolio", "negated insult"), ("not now, you foolio", "insult at target"), ("never, foolio", "insult"), ("she said you are a foolio", "reported insult"),
    ('"one. a foolio"', "reported insult"), ("she says: you foolio", "insult at target"), ("I will kill you", "threat at target"), ("I will not kill you", "negated threat"), ("he said he will kill you", "reported threat"),
])
def test_clauses(text, kind):
    assert [k for k, _ in toxicity.Grammar({"foolio": 8.0}).attacks(text)] == [kind]


def test_equally_strong_clauses_score_alike():
    grammar = toxicity.Grammar({"foolio": 8.0, "barrio": 8.0})
    one = grammar.score("you foolio")
    assert one == grammar.score("you barrio. you foolio") == grammar.score("you foolio. you foolio! you barrio") == grammar.score("you foolio barrio foolio")
    # in a clause the first of equal insults counts, between clauses of equal weight the kind of the higher factor
    assert grammar.attacks("barrio, not foolio") == [("insult", 8.0)] and grammar.attacks("not foolio barrio") == [("negated insult", 8.0)]
    assert grammar.score("not foolio. foolio") == grammar.score("foolio. not foolio") == grammar.score("foolio")


def test_edges(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(20 + k, 1, k % 2) for k in range(40)] * 2, "doc_id long, quality int, toxic int")
    for d, y in ((docs, labels), (docs, labels.where("toxic = 0")), (odd_documents(spark, empty=True), labels)):
        grammar = toxicity.train(d, y, remainder(5) != 0)
        scored = docs.select("doc_id", toxicity.scores(grammar)("text").alias("score")).collect()
        assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
        assert len({r["score"] for r in scored if r["doc_id"] == 7}) == 1
    assert odd_documents(spark, empty=True).select(toxicity.scores(toxicity.Grammar())("text")).count() == 0
    assert toxicity.Grammar({"foolio": 9.0}).score("plain words " * 50_000 + "you foolio") > 0.8


def test_recall_on_held_out_labels(spark):
    labels = read(spark, "/root/testdata/sf0.1", "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    hits = [r["predicted"] for r in rows if r["toxic"] == 1]
    alarms = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(hits) > 80 and sum(hits) >= 0.9 * len(hits) and sum(alarms) <= 0.02 * len(alarms)
