"""SentencePiece encoding by backtracking against the library; decoding; digests."""

import hashlib
import random

import public_tokenizers as public
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrel.llm import piece_codec
from kestrel.llm.queries import QUERIES
from tests.conftest import SF_SMALL

PATH = public.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = piece_codec.PieceEncoder(PATH)


def same(texts):
    got = OWN.encode(texts, True)
    return [t for t, g in zip(texts, got) if g.tolist() != LIB.encode(t or "", add_eos=True)]


def test_hard_texts():
    r = random.Random(1)
    assert not same([
        "", " ", "  ", "\n", "a", " a", "a ", " a  b   c ", "▁", "a▁b", "▁ ▁", "</s>", "<s>a</s>", "<0x0A>", "<unk>", "\0", "\x1f", "\u0085", "　x　", "é́", "中文字符", "🙂🙂",
        "x" * 20_000, "ab" * 9_000, " " * 10_000, "中" * 5_000, "\n" * 5_000, "the" * 5_000, "".join(r.choice("abcdefghij") for _ in range(20_000)),
        "x" * 63, "x" * 64, "x" * 65, " " + "y" * 63 + " " + "y" * 64 + " " + "y" * 65,
    ])


def test_random_pieces_and_characters():
    r, pieces = random.Random(2), list(OWN.id)
    alphabet = "ab thein ▁\n\t\réü中文字🙂0123.,!<0x0A>​　\xa0"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randrange(12))).replace("▁", r.choice([" ", "", "▁"])) for _ in range(3000)]
    assert not same(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    assert not same(texts)


def test_words_walked_alone_and_together_agree():
    r = random.Random(3)
    words = list({"".join(r.choice("aehinost▁") for _ in range(r.randrange(1, 60))).lstrip("▁") or "a" for _ in range(500)})
    words = [w.replace("▁", "") or "a" for w in words]
    for w, got in zip(words, OWN.encode_words(words)):
        assert OWN.walk([w])[0].tolist() == got.tolist()


def test_slices_and_forgetting(monkeypatch):
    monkeypatch.setattr(piece_codec, "SLICE", 40)
    monkeypatch.setattr(piece_codec, "REMEMBERED", 5)
    own = piece_codec.PieceEncoder(PATH)
    texts = ["many words here and there, again and  again\n\nand so on " * 20, "short", "", "x" * 300 + " y"] * 3
    assert [g.tolist() for g in own.encode(texts)] == [LIB.encode(t) for t in texts]


def test_pairs_are_forgotten_beyond_a_bound(monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED_PAIRS", 3)
    own = piece_codec.PieceEncoder(PATH)
    texts = ["one text of words", "another text of more words", "and a third"] * 2
    for t in texts:
        assert own.encode([t])[0].tolist() == LIB.encode(t)


def expected(doc_id, text):
    ids = LIB.encode(text or "", add_eos=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids)))


def test_edge_rows(edge_docs):
    coded = piece_codec.encode_and_decode(edge_docs, PATH)
    got = [tuple(r) for r in piece_codec.digests(coded).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(r["doc_id"], r["text"])) for r in edge_docs.collect())
    row = next(r for r in coded.collect() if r["doc_id"] == 1)
    assert row["decoded"] == "The first document has a few words." and row["ids"][-1] == 2


def test_empty_table(no_docs):
    out = piece_codec.digests(piece_codec.encode_and_decode(no_docs, PATH))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.collect() == []


def test_query_is_the_library(spark):
    got = sorted(tuple(r) for r in QUERIES["op11_sentencepiece_codec"](spark, SF_SMALL).collect())
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert got == sorted(expected(r["doc_id"], r["text"]) for r in docs)
