"""Ranked lexical search against plain scoring of every document, and its stated edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from estatelens.llm import lexical

from .test_operators import WORDS, odd_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, k):
    held = [(d, Counter(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, text in items:
        asked[i].update(terms(text))
    out = []
    for i, want in asked.items():
        scored = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * total // length
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, n in want.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(index, items, k, **more):
    return sorted((tuple(r) for r in lexical.search(index, items, k, **more).collect()), key=repr)


ITEMS = [(1, "alpha BETA gamma alpha"), (2, ""), (3, None), (4, "Ünïcode 𝒳 tabs"), (5, "nowhere to-be found"), (6, "one two one; same"), (7, "hunter2hunter2 password sigma")]


def test_terms():
    texts = ["", "A-b_C1 x", "Ünï 𝒳y\x00z\x7fq", "É É", " a\nb\tc", "日本、語"]
    assert [[t.decode() for t in lexical.terms_of(t)] for t in texts] == [terms(t) for t in texts]


@pytest.mark.parametrize("part_bytes", [1, 2000, 1 << 20])
def test_search_of_odd_documents(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(lexical, "LEAST_BYTES", 1)
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = spark.createDataFrame([(*i, 0, "x") for i in ITEMS], "item_id long, text string, part int, term string")
    assert found(lexical.build(docs, part_bytes), items, 3) == by_hand(rows, ITEMS, 3)


def test_ties_copies_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "LEAST_BYTES", 1)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(WORDS[:6], k=8))) for k in range(300)] + [(1000 - k, "alpha beta alpha") for k in range(200)] + [(50, "alpha beta alpha")] * 3
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))) for k in range(30)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(docs, 3000)
    assert found(index, asked, 20) == found(index, asked, 20, first=1) == by_hand(rows, items, 20)


def test_bounds_leave_parts_out(spark, monkeypatch):
    """Items whose rare terms few parts hold visit few parts, and lose nothing."""
    monkeypatch.setattr(lexical, "LEAST_BYTES", 1)
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randint(5, 60)) + ([f"rare{k // 40}"] * 3 if k % 40 < 12 else []))) for k in range(2000)]
    items = [(k, f"rare{k} alpha") for k in range(20)]
    index, asked = lexical.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4000), spark.createDataFrame(items, "item_id long, text string")
    visited = []
    assert found(index, asked, 5, visited=visited) == by_hand(rows, items, 5)
    weights, held = lexical.weighed(index, asked)
    assert 0 < sum(v.count() for v in visited) < lexical.bounds(weights, held).count() / 2


def test_empty_tables(spark):
    none = odd_documents(spark, empty=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(lexical.build(none), items, 3) == []
    assert found(lexical.build(odd_documents(spark)), items.where("false"), 3) == []
