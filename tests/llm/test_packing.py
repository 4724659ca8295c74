"""Packing: planners against their definitions, placed pieces against the tokenizer library, round trips."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kestrel.llm import packing
from kestrel.llm.queries import QUERIES, tokenizer
from tests.conftest import SF_SMALL

LIB = Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 0]


def bins_of(plan):
    return [sorted((n for n, c in content for _ in range(c)), reverse=True) for content, times in plan for _ in range(times)]


hists = st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12)


@settings(max_examples=150, deadline=None)
@given(hists)
def test_both_planners_pack_everything_within_capacity(hist):
    for plan in (packing.minimum_bin_slack, packing.best_fit_decreasing):
        bins = bins_of(plan(dict(hist), 40))
        assert Counter(n for b in bins for n in b) == Counter(hist)
        assert all(sum(b) <= 40 for b in bins)


@settings(max_examples=80, deadline=None)
@given(hists)
def test_each_minimum_slack_bin_is_the_fullest_possible(hist):
    left = Counter(hist)
    for content, times in packing.minimum_bin_slack(dict(hist), 40):
        for _ in range(times):
            seed = max(n for n, c in left.items() if c)
            sums = {0}
            for n, c in left.items():
                for _ in range(c - (n == seed)):
                    sums |= {s + n for s in sums if s + n <= 40 - seed}
            assert sum(n * c for n, c in content) == seed + max(sums)
            left -= Counter(dict(content))


@settings(max_examples=80, deadline=None)
@given(hists)
def test_best_fit_decreasing_equals_the_sequential_run(hist):
    bins: list[list[int]] = []
    for n in sorted(Counter(hist).elements(), reverse=True):
        fit = [b for b in bins if sum(b) + n <= 40]
        if fit:
            max(fit, key=sum).append(n)
        else:
            bins.append([n])
    got = bins_of(packing.best_fit_decreasing(dict(hist), 40))
    assert Counter(sum(b) for b in got) == Counter(sum(b) for b in bins)


def test_planners_reject_lengths_that_do_not_fit():
    for plan in (packing.minimum_bin_slack, packing.best_fit_decreasing):
        with pytest.raises(ValueError):
            plan({41: 1}, 40)
        assert plan({}, 40) == []


def check_pieces(rows, texts, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in texts.items():
        ids = np.array(ids_of(t), "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == capacity for r in own[1:]) and (len(own) == 1 or len(ids) > capacity)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0] + [r["length"] for r in s[:-1]]))
        assert sum(r["length"] for r in s) <= capacity
    return len(by_seq)


def test_whole_table(spark):
    rows = QUERIES["op6_bin_slack_packing"](spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    n = check_pieces(rows, texts, 2048)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1  # at most one sequence more than the tokens need


def test_edges(edge_docs, no_docs):
    docs = edge_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for capacity in (16, 100, 2048):
        rows = packing.pack_tightly(docs, capacity=capacity, with_ids=True, **tokenizer()).collect()
        check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, capacity)
        assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    twice = packing.pack_tightly(edge_docs, **tokenizer()).collect()
    assert len([r for r in twice if r["doc_id"] == 7]) == 2 and len([r for r in twice if r["doc_id"] is None]) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    assert packing.pack_tightly(no_docs, **tokenizer()).count() == 0
    assert packing.packed_matrix(no_docs, **tokenizer()).count() == 0


def test_a_length_that_many_share_is_numbered_in_buckets(spark):
    items = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 7L, id % 5 + 1) as length")
    placed = packing.place(items, packing.minimum_bin_slack, 20, bucket_rows=50)[0].collect()
    assert len(placed) == 5000 and len({r["doc_id"] for r in placed}) == 5000
    by_seq = {}
    for r in placed:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0] + [r["length"] for r in s[:-1]]))


def unpack(rows, capacity):
    parts = {}
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        ids, pos, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == capacity and cu[0] == 0 and cu[-1] == r["n_tokens"] and len(cu) == r["n_segments"] + 1
        assert (ids[r["n_tokens"] :] == 0).all() and (pos[r["n_tokens"] :] == 0).all()
        for a, b, i, k in zip(cu, cu[1:], r["doc_ids"], r["pieces"]):
            assert (pos[a:b] == np.arange(b - a)).all()
            parts[i, k] = ids[a:b].tolist()
    return parts


@pytest.mark.parametrize("capacity", [64, 2048])
def test_matrix_round_trip(edge_docs, capacity):
    docs = edge_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    parts = unpack(packing.packed_matrix(docs, capacity=capacity, **tokenizer()).collect(), capacity)
    for r in docs.collect():
        got = [x for k in sorted(k for i, k in parts if i == r["doc_id"]) for x in parts[r["doc_id"], k]]
        assert got == ids_of(r["text"])


def test_matrix_query(spark):
    rows = QUERIES["op10_packed_matrix"](spark, SF_SMALL).collect()
    parts = unpack(rows, 2048)
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        assert [x for k in sorted(k for i, k in parts if i == r["doc_id"]) for x in parts[r["doc_id"], k]] == ids_of(r["text"])
    assert len(rows) <= 1.02 * math.ceil(sum(r["n_tokens"] for r in rows) / 2048) + 1
