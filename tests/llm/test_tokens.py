"""Token counts: the transducers against the tokenizer library, as text pieces, random strings and tables."""

import numpy as np
import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kestrel.llm import token_counts
from kestrel.llm.queries import QUERIES, tokenizer
from kestrel.llm.token_fst import C_END, N_STATES, TokenCounter, compose_scan, safe_slices
from tests.conftest import SF_SMALL

PATH = public.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
COUNTER = TokenCounter(PATH)


def lib_counts(texts):
    return [len(e.ids) for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts():
    texts = [
        "", " ", "\n", "  \n ", "a", "I'll've it's 'S 're 'r 'l", "'s's're'x 't", " 's", "a'll", "1'll", "!'ll", "\t'd", "word  word\n\nword ",
        "<|endoftext|>", "a<|endoftext|><|endoftext|>b ", "<|endoftext", "x" * 5000, " " * 3000 + "x", "\n" * 700, "ab" * 700 + " " + "!" * 900,
        "中文字符", "é́é", " a b　", "\U0001f642\U0001f642", "0123456789" * 100, "\x00\x01\x7f\x80\x85\xa0", "naïve café",
    ]
    assert COUNTER.counts(texts) == lib_counts(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab's tre\nllvmd12.!é中 ", max_size=200)), max_size=8))
def test_random_texts(texts):
    assert COUNTER.counts(texts) == lib_counts(texts)


def test_every_code_point_in_context():
    points = [*range(0, 0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1FB00), 0x10FFFF]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[i : i + 64]) for i in range(0, len(points), 640)]
    assert COUNTER.counts(texts) == lib_counts(texts)


def test_forgetting_states_changes_nothing():
    texts = ["words and more words in lines\n" * 20, "x" * 3000, "quite different, isn't it? 123"]
    small = TokenCounter(PATH)
    small.transducer.max_states = 40
    assert [small.counts([t])[0] for t in texts * 2] == lib_counts(texts) * 2


def test_slices_of_long_texts_count_alike():
    from kestrel.llm.packing import Encoder

    text = "it's a  word,\n and 12 more 'words'  é中 here\t x " * 40
    for size in (1, 5, 17, 100):
        parts = list(safe_slices(text, size))
        assert "".join(parts) == text and (size > 17 or len(parts) > 20)
        assert sum(lib_counts(parts)) == lib_counts([text])[0]
        assert [i for p in parts for i in LIB.encode(p, add_special_tokens=False).ids] == LIB.encode(text, add_special_tokens=False).ids
    assert list(safe_slices("x" * 100, 10)) == ["x" * 100] and list(safe_slices("", 10)) == [""]
    assert Encoder(**tokenizer()).encode("").tolist() == []


def test_chunks_compose_like_one_run():
    text = ("it's a 're  \n mix'll of 123 !'s " * 300)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sym = np.append(COUNTER.splitter.classes(points), C_END).astype(np.uint8)
    whole = COUNTER.splitter.starts(sym, chunk=len(sym))
    for chunk in (1, 2, 3, 7, 64, 1000):
        assert (COUNTER.splitter.starts(sym, chunk=chunk) == whole).all()


def test_scan_of_maps_is_composition():
    maps = np.random.default_rng(0).integers(0, N_STATES, (37, N_STATES)).astype(np.uint8)
    got, at = compose_scan(maps), np.arange(N_STATES)
    for row, m in zip(got, maps):
        at = m[at]
        assert (row == at).all()


def test_table_edges(edge_docs, no_docs):
    rows = token_counts.count_tokens(edge_docs, PATH, 1024).collect()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect() if r["doc_id"] is not None}
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), lib_counts([t])[0], lib_counts([t])[0] > 1024)
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] is None) == [0, lib_counts(["A document without an id, but with words."])[0]]
    assert token_counts.count_tokens(no_docs, PATH, 1024).count() == 0


def test_query_equals_the_library(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op2_token_counts"](spark, SF_SMALL).collect()}
    assert got == dict(zip(docs, lib_counts(list(docs.values()))))


def test_both_encoders_agree_on_plain_characters():
    from kestrel.llm.packing import Encoder, _plain

    enc = Encoder(**tokenizer())
    plain = [c for c in range(0x300) if _plain(chr(c))]
    assert plain == list(range(0x100))
    for text in (" " * 50000 + "x", "\n" * 5000, " \n\t" * 3000, "ab" * 20000, "!?" * 5000, "7" * 9999):
        assert enc.fast.encode_ordinary(text) == LIB.encode(text, add_special_tokens=False).ids
    for c in plain:
        for text in (f"a{chr(c)}b", f"1{chr(c)}2", f"!{chr(c)}?", f" {chr(c)} ", f"{chr(c)}{chr(c)}a", f"x\n{chr(c)}'s"):
            assert enc.fast.encode_ordinary(text) == LIB.encode(text, add_special_tokens=False).ids, (c, text)
