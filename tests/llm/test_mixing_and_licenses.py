"""Source mixing and licence scan: DuckDB twins, both bisection targets, edge tables."""

import math

import pytest
from pyspark.sql import functions as F

from kestrel.llm import license_scan, source_mixing
from kestrel.llm.queries import ORACLES, QUERIES
from kestrel.llm.source_mixing import Mixture
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    res = duck.execute(ORACLES[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["op7_temperature_mixing", "op9_license_scan"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct", "NestedLoopJoin"))


def sizes(spark, tokens):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source_key string, tokens long")


def test_repetition_limit(spark):
    rows = source_mixing.quotas(sizes(spark, [1000, 100, 100, 10]), Mixture(max_repeats=2.0)).collect()
    passes = [r["quota"] / r["tokens"] for r in rows]
    assert min(passes) == 1.0 and 1.9 <= max(passes) <= 2.0
    assert all(r["exponent"] == pytest.approx(1 - math.log(2) / math.log(100), abs=1e-8) for r in rows)
    equal = source_mixing.quotas(sizes(spark, [7, 7]), Mixture()).collect()
    assert all(r["quota"] == 7 and r["full"] == 1 and r["rest"] == 0 for r in equal)


def test_repetition_limit_with_a_budget(spark):
    rows = source_mixing.quotas(sizes(spark, [1000, 100, 10]), Mixture(max_repeats=3.0, budget_tokens=555)).collect()
    assert abs(sum(r["quota"] for r in rows) - 555) <= 2
    assert max(r["quota"] / r["tokens"] for r in rows) <= 3.05


def test_target_entropy(spark):
    rows = source_mixing.quotas(sizes(spark, [1000, 100, 10]), Mixture(target_entropy=0.8, budget_tokens=100_000)).collect()
    w = [r["weight"] for r in rows]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(0.8, abs=1e-6)
    flat = source_mixing.quotas(sizes(spark, [1000, 100, 10]), Mixture(target_entropy=5.0)).collect()
    assert [r["weight"] for r in flat] == pytest.approx([1 / 3] * 3)  # more than can be: the flattest


def test_permutation_is_whole_and_within_budget(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('w ', cast(id % 9 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    for m in (Mixture(max_repeats=2.5), Mixture(max_repeats=2.5, block_digits=1)):
        rows = source_mixing.mix_sources(docs, m).collect()
        plan = {r["source_key"][1:]: r for r in source_mixing.quotas(docs.select(F.concat(F.lit("s"), "source").alias("source_key"), source_mixing.n_tokens("text").alias("n"))
                                                                   .groupBy("source_key").agg(F.sum("n").alias("tokens")), m).collect()}
        for s, p in plan.items():
            own = sorted((r for r in rows if r["source"] == s), key=lambda r: r["position"])
            at = 0
            for r in own:  # gapless: each copy starts where the one before ends
                assert r["position"] == at
                at += r["n_tokens"]
            assert p["quota"] - 9 < at <= p["quota"]
            assert {r["doc_id"] for r in own if r["epoch"] == 0} == {r["doc_id"] for r in docs.filter(F.col("source") == s).collect()}
            assert all(0 <= r["mix_key"] < 1 for r in own)


def test_mixing_edges(edge_docs, no_docs):
    rows = source_mixing.mix_sources(edge_docs).collect()
    assert {(r["doc_id"], r["source"]) for r in rows if r["epoch"] == 0} == {(r["doc_id"], r["source"]) for r in edge_docs.collect()}
    assert len([r for r in rows if r["doc_id"] == 7 and r["epoch"] == 0]) == 2
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    wide = source_mixing.mixed_rows(edge_docs)
    assert wide.columns == edge_docs.columns
    count = lambda rs: {i: sum(r["doc_id"] == i for r in rs) for i in range(1, 10)}
    assert count(wide.collect()) == count(rows)
    assert source_mixing.mix_sources(no_docs).count() == 0 and source_mixing.mixed_rows(no_docs).count() == 0


def test_mixed_rows_equal_the_mixture(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a = source_mixing.mix_sources(docs).groupBy("doc_id").count().collect()
    b = source_mixing.mixed_rows(docs).groupBy("doc_id").count().collect()
    assert sorted(a) == sorted(b)


def test_license_spellings_and_edges(spark, no_docs):
    mit = license_scan._MIT
    docs = spark.createDataFrame([
        (1, "MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;"), 0),
        (2, mit + " and more", 0),
        (3, "Some words.\n  licensed under the APACHE Licence -- version 2.0 \r\nMore words.\nLicensed under the Apache License, Version 2.0.", 0),
        (4, "Not licensed under the Apache License, Version 2.0.", 0),
        (5, None, 0), (6, "", 0), (7, "\n\n...\n", 0), (8, "Copyright 2020 A. Person", 0),
        (None, "Released under the MIT License.", 0), (9, "Released under the MIT License.", 0), (9, "Released under the MIT License.", 0),
        (10, "Licensed under CC BY-NC 4.0.", 0), (11, "This work is licensed under the GNU GPL, version 3.", 0),
    ], "doc_id long, text string, license int")
    got = {(r["doc_id"], r["license"]): (r["whole_text"], r["n_lines"]) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {
        (1, "MIT"): (True, 0), (3, "Apache-2.0"): (False, 2), (None, "MIT"): (True, 1), (9, "MIT"): (True, 2),
        (10, "CC-BY-NC-4.0"): (True, 1), (11, "GPL-3.0"): (True, 1),
    }
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_full_texts_and_spdx_lines(spark):
    from kestrel.llm import license_texts

    docs, want = [], {}

    def plant(name, text, whole, lines):
        docs.append((len(docs), text))
        want[len(docs) - 1] = (name, whole, lines)

    for name, text in license_texts.TEXTS.items():
        plant(name, text, True, 0)
        plant(name, "Copyright (c) 2021, A. Person\n\n" + text.upper().replace("\n", "\r\n"), True, 0)
        plant(name, "\n\n".join(" ".join(p.split()) for p in text.split("\n\n")), True, 0)
        plant(name, " ".join(text.split()), True, 1)
    bsd = license_texts.TEXTS["BSD-3-Clause"]
    plant("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2020 X\nAll rights reserved.\n\n" + bsd.replace("1. ", "- ").replace("2. ", "- ").replace("3. ", "- "), True, 0)
    plant("Apache-2.0", license_texts.TEXTS["Apache-2.0"].split("APPENDIX: How")[0], True, 0)
    for i, name in {"GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "BSD-2-Clause": "BSD-2-Clause", "LGPL-2.1-only": "LGPL-2.1", "MPL-2.0": "MPL-2.0",
                    "CC0-1.0": "CC0-1.0", "AGPL-3.0-or-later": "AGPL-3.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "MIT": "MIT"}.items():
        plant(name, f"# SPDX-License-Identifier: {i}\nimport os", False, 1)
    docs += [(-1, license_texts.TEXTS["GPL-3.0"][:-300]), (-2, bsd + "and more"), (-3, "SPDX-License-Identifier: Some-1.0")]
    rows = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["license"], r["whole_text"], r["n_lines"]))
    for i, (name, whole, lines) in want.items():
        found = [x for x in got.get(i, []) if x[0] == name]
        assert [(w, n if lines else 0) for _, w, n in found] == [(whole, lines)], (i, name, got.get(i))
        assert len(got[i]) == 1 or not lines, (i, got[i])
    assert not {-1, -2, -3} & set(got)


def test_each_known_digest_is_one_license(spark):
    rows = license_scan.known_digests(spark).collect()
    assert len({r["digest"] for r in rows}) == len(rows) > 100
