"""SimHash: fingerprints and components against brute force; keys of all near pairs."""

import re

import numpy as np
import xxhash

from kestrel.llm import simhash
from kestrel.llm.common import connected_components
from kestrel.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode("utf-8", "surrogatepass"), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """doc ids -> smallest id reachable over pairs within two bits."""
    ids = sorted(prints)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and comp[b] > comp[a]:
                    comp[b], changed = comp[a], True
    return comp


def test_fingerprints_of_hard_texts():
    texts = [None, "", " ", "a", "A b", "a  B\tc", "ÄÖ äö ÄÖ", "x y z   w", "a b c a b c a b c", "word " * 5000, "\x0b\x0c a \x1c b"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t
        assert simhash.fingerprint(t, block=7) == plain_fingerprint(t), t


def test_every_pair_within_two_bits_shares_a_key():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    flips = np.array([0] * 1000 + [1] * 1000 + [2] * 1000)
    v = u.copy()
    for i, n in enumerate(flips):
        for b in rng.choice(64, n, replace=False):
            v[i] ^= np.uint64(1) << np.uint64(b)
    for one, several in ((u, v), (v, u)):
        a, b = simhash.fuzzy_keys(one.view(np.int64), False), simhash.fuzzy_keys(several.view(np.int64), True)
        assert all(np.isin(x, y).any() for x, y in zip(a, b))


def test_the_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[:: 97]
    index = simhash.codeword_index(words)
    assert index.max() < 4096
    every = simhash._ERRORS[0][simhash._syndromes(words)]
    assert max(int(e).bit_count() for e in every) <= 3
    sizes = {len(np.unique(r)) for r in simhash.nearby_indices(words[:2000])}
    assert sizes == {1, 6}


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    comp = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_near_dedup"](spark, SF_SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in texts}


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 64, 30, dtype=np.uint64)]
    prints = set(base)
    for b in base:
        x = b
        for _ in range(6):  # chains of one or two bits, which leave the first fingerprint's neighbourhood
            for bit in rng.choice(64, rng.integers(1, 3), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in links} == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1002), (1002, 1001), (5, 5)] + [(5000, 5000 + i) for i in range(1, 300)]
    got = {r["node"]: r["label"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 1000: 1000, 1001: 1000, 1002: 1000, **{5000 + i: 5000 for i in range(300)}}


def test_edges(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == "0" * 16
    assert {by_id[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert {by_id[i]["component_id"] for i in (1, 7)} == {1}
    nameless = sorted((r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] is None)
    assert nameless[0] == ("0" * 16, 2) and nameless[1][1] is None
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(i for i, _ in got if i is not None) == [1, 2, 5, 6, 8, 9]
    assert [t for i, t in got if i is None] == ["A document without an id, but with words."]
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_keeps_each_group_where_ids_repeat(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(5, a), (5, b), (5, a), (3, c), (5, c), (5, d), (9, d), (None, a), (None, "x y z w"), (None, "x y z w")]
    rows += [(4, f"{' '.join(f't{n}u{i}' for i in range(30))}") for n in range(30)]
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = [(5, a), (5, b), (3, c), (5, d), (None, "x y z w"), *rows[10:]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
