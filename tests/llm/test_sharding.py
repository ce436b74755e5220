"""K-d sharding against a tree grown by hand, groups, and the query's columns."""

import random
from collections import Counter, defaultdict

import pytest

from estatelens.llm import kd_sharding
from estatelens.llm.common import materialize
from estatelens.llm.queries import QUERIES


def key_of(p, dim):
    return p[dim] * 2 ** (kd_sharding.HASH_BITS + kd_sharding.PIECE_BITS) + p["tie"]


def check_tree(points, first, k, limit, span):
    """Splits of the node's shards [first, first + k) as a tree grown by hand would make them; returns the number of splits seen."""
    if k == 1 or not points:
        return 0
    extent = {d: (max(p[d] for p in points) - min(p[d] for p in points)) / (span[d] or 1) for d in kd_sharding.DIMENSIONS}
    dim = max(kd_sharding.DIMENSIONS, key=lambda d: (extent[d], -kd_sharding.DIMENSIONS.index(d)))
    left = [p for p in points if p["shard"] < first + k // 2]
    right = [p for p in points if p["shard"] >= first + k // 2]
    if left and right:
        assert max(key_of(p, dim) for p in left) < min(key_of(p, dim) for p in right)
    wanted = (k // 2) / k * sum(p["bytes"] for p in points)
    by_key = Counter()
    for p in points:
        by_key[key_of(p, dim)] += p["bytes"]
    below, best = 0, wanted  # the nearest that a cut between two keys comes to the median
    for _, weight in sorted(by_key.items()):
        below += weight
        best = min(best, abs(below - wanted))
    assert abs(sum(p["bytes"] for p in left) - wanted) <= best + limit / 2
    return 1 + check_tree(left, first, k // 2, limit, span) + check_tree(right, first + k // 2, k - k // 2, limit, span)


@pytest.mark.parametrize("shards, n", [(1, 20), (3, 200), (16, 3000), (4096, 20_000)])
def test_tree_equals_one_grown_by_hand(spark, shards, n):
    rng = random.Random(shards)
    data = [(k, rng.choice([1, 5, 40, 300, 5000]), rng.randrange(1 << 20), rng.choice([7, 900, 70_000]), rng.choice([3, 500_000, 900_000]), k * 50 % (1 << 20), rng.randrange(1 << 43)) for k in range(n)]
    points = materialize(spark.createDataFrame(data, "id long, bytes long, by_size long, by_lang long, by_source long, by_id long, tie long"), "points")
    limit = max(1, int(sum(r[1] for r in data) / shards / 512))
    got = [r.asDict() for r in kd_sharding.grown(points, shards, limit).collect()]
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in data) and {r["shard"] for r in got} <= set(range(shards))
    span = {d: max(r[d] for r in got) - min(r[d] for r in got) for d in kd_sharding.DIMENSIONS}
    assert check_tree(got, 0, shards, limit, span) >= min(shards - 1, 1)


def test_groups_are_cut_by_one_rule(spark):
    rng = random.Random(2)
    rows = [(k, f"text {k} " + "word " * rng.randint(1, 30), "en", f"s{k % 5}") for k in range(3000)]
    rows += [(5000 + k, "one very common line", "de", "hot") for k in range(1500)] + [(9000 + k, "x " * 200 + f"pair {k // 2}", "fr", f"s{k % 4}") for k in range(60)]
    got = kd_sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).collect()
    text, weight, where = {r[0]: r[1] for r in rows}, Counter(), defaultdict(set)
    for r in got:
        weight[r["shard"]] += r["size"]
        where[text[r["doc_id"]]].add(r["shard"])
    mean = sum(weight.values()) / 8
    assert len(weight) == 8 and all(abs(w - mean) < 0.02 * mean for w in weight.values())
    torn = [t for t, s in where.items() if len(s) > 1]
    assert len(torn) <= 7  # no more than there are splits
    heavy = [t for t, c in Counter(text.values()).items() if c > 1 and c * (len(t) + 1) > mean / 512]
    assert set(torn) <= set(heavy)


def test_query_has_the_contract_s_columns(spark, sf):
    got = QUERIES["op2_kd_sharding"](spark, sf)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = got.collect()
    assert {r["shard"] for r in rows} <= set(range(16)) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
