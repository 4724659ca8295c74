"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers as public
import sentencepiece
from tokenizers import Tokenizer

from kestrel.llm import token_alignment
from kestrel.llm.queries import QUERIES
from tests.conftest import SF_SMALL

A_PATH, B_PATH = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
ALPHABET = token_alignment.byte_alphabet()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def a_bytes(i):
    return bytes(ALPHABET[c] for c in A.id_to_token(i))


def b_bytes(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def groups_of(text):
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    ends = []
    for ids, spell in ((a, a_bytes), (b, b_bytes)):
        at, out = 0, []
        for i in ids:
            at += len(spell(i))
            out.append(at)
        ends.append(out)
    if not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + text).encode():
        return []
    both, own = set(ends[0]) & set(ends[1]), []
    for ids, es in zip((a, b), ends):
        own.append([[]])
        for i, e in zip(ids, es):
            own[-1][-1].append(i)
            if e in both:
                own[-1].append([])
    return list(zip(own[0][:-1], own[1][:-1]))


def expected(rows):
    links = []
    for _, text in rows:
        links.append(Counter((x, y) for xs, ys in groups_of(text) for x in xs for y in ys))
    count = Counter(p for own in links for p in own)
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, text), own in zip(rows, links):
        gs = groups_of(text)
        shown = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in gs)
        out.append((
            doc_id, sum(len(xs) for xs, _ in gs), sum(len(ys) for _, ys in gs), len(gs), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(shown.encode()).hexdigest() if gs else "",
        ))
    return sorted(out, key=str)


def check(docs):
    got = token_alignment.align_tokenizers(docs, A_PATH, B_PATH)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_rows(edge_docs):
    check(edge_docs)


def test_empty_table(no_docs):
    out = token_alignment.align_tokenizers(no_docs, A_PATH, B_PATH)
    assert out.columns == COLUMNS and out.collect() == []


def random_texts(seed, n):
    r = random.Random(seed)
    alphabet = "ab thein 's're \n\t\r  éü中文🙂0123.,!<|endoftext|> \xa0　▁\x1f\x85"
    words = ["the", "of", "and", "Straße", "naïve", "don't", "I'll", "中文", "x", "\n", "\n\n", "  ", "123", "...", "▁" if n % 2 else "-", " ", "\t"]
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 50))) for _ in range(n)]
    return out + [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(n)]


def test_random_texts(spark):
    rows = [(i, t) for i, t in enumerate(random_texts(5, 150))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_words_do_not_depend_on_their_neighbours():
    own = token_alignment.Aligner(A_PATH, B_PATH)
    texts = random_texts(6, 1500)
    for t, tally in zip(texts, own.documents(texts)):
        if tally.spelled:
            assert tally.sizes[0] == len(A.encode(" " + t, add_special_tokens=False).ids), t
            assert tally.sizes[1] == len(B.encode(t)), t
        else:
            assert "▁" in t


def test_slices_and_long_groups(monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE", 60)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 20)
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", 3)
    own = token_alignment.Aligner(A_PATH, B_PATH)
    texts = ["Some words that go on and on, in more than one slice. " * 8, "x" * 500, "a", None, "", "中文字符" * 40 + " end", "words ▁ here " + "and more words " * 9, "fine again"]
    for t, tally in zip(texts, own.documents(texts)):
        gs = groups_of(t)
        links = Counter(((x << token_alignment.SHIFT) + y) for xs, ys in gs for x in xs for y in ys)
        got = dict(zip(*(x.tolist() for x in tally.pairs)))
        for x, n in zip(*(v.tolist() for v in tally.mapped)):
            got[(x << token_alignment.SHIFT) + int(own.identity[x])] = n
        assert got == dict(links)
        assert tally.sizes.tolist() == [sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(links.values())]


class Counted:
    """A tokenizer that notes the strings it is given."""

    def __init__(self, own):
        self.own, self.strings = own, []

    def encode_batch_fast(self, strings, **kw):
        self.strings += strings
        return self.own.encode_batch_fast(strings, **kw)


def test_new_words_are_encoded_together_and_once():
    r = random.Random(7)
    own = token_alignment.Aligner(A_PATH, B_PATH)
    own.a = counted = Counted(own.a)
    words = sorted({"".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(2000)})
    texts = [" ".join(r.choices(words, k=400)) for _ in range(30)]
    first = own.documents(texts)
    assert len(counted.strings) <= len(words) / 50
    counted.strings.clear()
    again = own.documents(texts[::-1])[::-1]
    assert not counted.strings
    for t, x, y in zip(texts, first, again):
        gs = groups_of(t)
        assert x.sizes.tolist() == y.sizes.tolist() == [sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(len(a) * len(b) for a, b in gs)]
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        assert x.digest.hexdigest() == y.digest.hexdigest() == hashlib.sha256(shown.encode()).hexdigest()


def test_only_words_that_are_not_spelled():
    own = token_alignment.Aligner(A_PATH, B_PATH)
    for _ in range(2):
        assert [(x.spelled, x.sizes.tolist(), x.digest) for x in own.documents(["a▁b", "▁", None])] == [(False, [0] * 4, None)] * 2 + [(True, [0] * 4, None)]
    assert own.documents(["a▁b", "plain"])[1].sizes.tolist() == own.documents(["plain"])[0].sizes.tolist()


def test_vocabularies_that_do_not_spell_every_word():
    own, whole = token_alignment.Aligner(A_PATH, B_PATH), token_alignment.Aligner(A_PATH, B_PATH)
    odd = B.encode("zebra")[-1]
    own.b_bytes[odd] = b"?" * len(own.b_bytes[odd])  # a piece that stands for other bytes
    texts = ["a zebra here", "none of them here", "zebra", "and here"]
    got, as_before = own.documents(texts), whole.documents(texts)
    assert [x.spelled for x in got] == [False, True, False, True]
    assert [got[i].sizes.tolist() for i in (1, 3)] == [as_before[i].sizes.tolist() for i in (1, 3)]


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op13_token_alignment"](spark, SF_SMALL).collect()), key=str)
    assert got == expected(rows)
