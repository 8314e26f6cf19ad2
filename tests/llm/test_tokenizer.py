"""Encoding against two public encoders of the same vocabulary; streaming; decoding."""

import os
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
if not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"):
    pytest.skip("no vocabulary here", allow_module_level=True)

from quern.llm import arrays  # noqa: E402
from quern.llm.tokenizer import Encoder, Merges, StreamDecoder, Transducer, decode, encode, read_ranks  # noqa: E402

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "''", "1", "23", ".", "!?", "é", "中文", " ", "　", "😀", "ß", "́", "_", "²", "Ⅷ", "'ll", "'LL", "\x00", "\x1c", " ", "<|endoftext|>", "۳", "hello", "ing", " don't", "\r\n", "​", "'d", "'mx"]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks()


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]


def test_against_the_public_encoder(ranks, public):
    rng = random.Random(1)
    texts = ["", None, " ", "'", "'s", "x" * 3000] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    got = split(*Encoder(ranks)(texts))
    assert got == [public.encode_ordinary(t or "") for t in texts]


def test_against_the_other_public_library(ranks):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert split(*Encoder(ranks)(texts)) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_cut_where_a_pretoken_starts(ranks, public, monkeypatch):
    import quern.llm.tokenizer as module

    monkeypatch.setattr(module, "PIECE", 50)
    monkeypatch.setattr(arrays.pieces, "__defaults__", (50,))
    texts = ["it's  a long\n\n text, isn't it? " * 30, "no" * 200, "a b", "a'll1'S. \n\n3x's'" * 40, "x1" * 300, "1,2;3\t\t4" * 90, "中文。" * 200, "'s" * 300, "don't\n" * 99]
    rng = random.Random(3)
    texts += ["".join(rng.choice(PIECES) for _ in range(600)) for _ in range(60)]
    assert split(*Encoder(ranks)(texts)) == [public.encode_ordinary(t) for t in texts]


def test_what_lies_behind_the_lookahead_is_emitted():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"ba": 257, b"abab": 258, b"aa": 259}
    merges, rng = Merges(ranks), random.Random(4)
    assert merges.lookahead == merges.sufficient_lookahead() == 4 * 4
    late = []
    for _ in range(300):
        data = bytes(rng.choice(b"ab") for _ in range(200)) if _ % 3 else rng.choice([b"a", b"ab", b"ba", b"aab"]) * 90
        t = Transducer(merges)
        out = []
        for i in range(0, len(data), 7):
            out += t.feed(data[i : i + 7])
            late.append(len(t.data))
        assert out + t.finish() == merges.plain(data)
    assert max(late) <= merges.lookahead + 8 * merges.reach


@pytest.mark.parametrize("base", ["ab", "aaa", "lollollo", "中", "=-", "abcdefghijklmnopqrstuvwxyz"])
def test_the_transducer_streams_in_constant_memory(ranks, base):
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(base)
    text = (base * 3000)[:6000] + "".join(rng.choice("abcdethinrs") for _ in range(2000))
    t, out, data, held = Transducer(Merges(ranks)), [], text.encode(), 0
    for i in range(0, len(data), 333):
        out += t.feed(data[i : i + 333])
        held = max(held, len(t.data))
    assert out + t.finish() == whole.encode_ordinary(text)
    assert held < 2000 and t.most <= t.m.sufficient_lookahead()


def test_small_merge_lists_against_plain_merging():
    rng = random.Random(3)
    for _ in range(30):
        ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
        while len(ranks) < 25:
            ranks.setdefault(rng.choice(list(ranks)) + rng.choice(list(ranks)), len(ranks))
        m = Merges(ranks)
        if not all(m.whole(i) for i in ranks.values()):
            continue
        for _ in range(60):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            t = Transducer(m)
            assert t.feed(data) + t.finish() == m.plain(data)


def test_decoding_is_incremental(ranks):
    bytes_of = {i: b for b, i in ranks.items()}
    text = "中文 😀 é plain"
    ids, _ = Encoder(ranks)([text])
    d = StreamDecoder(bytes_of)
    parts = [d.feed([i]) for i in ids.tolist()]
    assert "".join(parts) + d.finish() == text and "" in parts
    d = StreamDecoder(bytes_of)
    assert d.feed([ranks[b"\xe4"]]) == "" and d.finish() == "�"


def test_on_spark(spark, public):
    rows = [(1, "it's 中文", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "it's 中文", "x"), (4, "y" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode(docs).collect()), key=repr)
    assert got == sorted(((i, public.encode_ordinary(t or "")) for i, t, _ in rows), key=repr)
    back = sorted((tuple(r) for r in decode(encode(docs)).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert encode(docs.limit(0)).collect() == [] and decode(encode(docs.limit(0))).collect() == []
