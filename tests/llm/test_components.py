"""Connected components against union-find, on shapes that are slow for label propagation."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.llm.common import connected_components
from kestrel.llm.simhash import near_duplicates_of_fingerprints


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def shuffled(pairs, seed=1):
    names = sorted({x for p in pairs for x in p})
    new = random.Random(seed).sample(range(-(10**12), 10**12), len(names))
    name = dict(zip(names, new))
    return [(name[a], name[b]) for a, b in pairs]


SHAPES = {
    "chain": [(i, i + 1) for i in range(100_000)],
    "grid": [(100 * i + j, 100 * i + j + d) for i in range(99) for j in range(99) for d in (1, 100)],
    "star and chain": [(0, i) for i in range(1, 4000)] + [(i, i + 1) for i in range(10_000, 18_000)],
    "small": [(1, 1), (2, 3), (3, 2), (5, 4), (4, 6), (7, 7)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_against_union_find(spark, shape):
    pairs = shuffled(SHAPES[shape]) if shape != "small" else SHAPES[shape]
    got = connected_components(spark, spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["label"] for r in got} == union_find(pairs)


def test_no_links(spark):
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


def test_chain_of_fingerprints(spark):
    """5,000 fingerprints, each two bits from the one before: one component, whatever their numbers."""
    fp, chain, seen = random.Random(4).getrandbits(64), [], set()
    r = random.Random(5)
    while len(chain) < 5000:
        if fp not in seen:
            seen.add(fp)
            chain.append(fp)
        a, b = r.sample(range(64), 2)
        fp ^= 1 << a | 1 << b
    signed = [x - (1 << 64) if x >> 63 else x for x in chain]
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long").repartition(4)
    got = near_duplicates_of_fingerprints(prints, 2)
    assert got.count() == 5000 and got.filter(F.col("component_id") != 0).isEmpty()
