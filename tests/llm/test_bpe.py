import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
DATA = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, " ", "a", "aaaaaaaaaaa aaaa", "a" * 3000, "\n\n  x \t y ", "It's we'll DON'T", "naïve façade übergrößen", "日本語テキスト", "!!!!!!! --- ...", "1234567 12 3", "\x1c\x1d a\x1fb", "\u00a0x\u2003y", "👩‍👩‍👧 ok", "<|endoftext|>", "same", "same"]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_as_the_library():
    encode = bpe.Encoder(bpe._vocabulary(DATA), P.PATTERN)
    assert [ids(x) for x in encode(TEXTS)] == [REF.encode_ordinary(t or "") for t in TEXTS]
    assert [ids(x) for x in encode(TEXTS)] == [REF.encode_ordinary(t or "") for t in TEXTS]  # from what it remembers


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    encode = bpe.Encoder(bpe._vocabulary(DATA), P.PATTERN)
    assert [ids(x) for x in encode(texts)] == [REF.encode_ordinary(t) for t in texts]


@settings(deadline=None, max_examples=1000)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=5), st.permutations(range(12)))
def test_odd_ranks(words, order):
    """Ranks that no training gives: pairs of lower rank may appear late."""
    tokens = [bytes([b]) for b in range(256)] + [[b"aa", b"ab", b"ba", b"bb", b"aab", b"aba", b"abb", b"bab", b"aaaa", b"abab", b"abba", b"bbaa"][i] for i in order]
    vocab = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    runs, counts = bpe.replay(vocab, [w.encode() for w in words])
    got = [x.tolist() for x in np.split(runs, np.cumsum(counts)[:-1])]
    assert got == [vocab.one_by_one(w.encode()) for w in words]


def test_frames(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = bpe.digests(df, PATH, P.PATTERN).orderBy("doc_id").collect()
    for r, t in zip(rows, TEXTS):
        want = REF.encode_ordinary(t or "")
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
    lists = bpe.ids_array(bpe.encode(df, PATH, P.PATTERN)).orderBy("doc_id").collect()
    assert [x["ids_array"] for x in lists] == [REF.encode_ordinary(t or "") for t in TEXTS]


@pytest.mark.parametrize("size", [1, 7])
def test_small_chunks(monkeypatch, size):
    monkeypatch.setattr(bpe, "CACHE_WORDS", size)
    encode = bpe.Encoder(bpe._vocabulary(DATA), P.PATTERN)
    for t in TEXTS:
        assert ids(encode([t])[0]) == REF.encode_ordinary(t or "")


def test_every_pair_whose_rank_is_below_a_part():
    """Such pairs may open late; their strings, alone, doubled and side by side, against the library."""
    vocab = bpe._vocabulary(DATA)
    pairs = zip((vocab.keys[:-1] >> 20).tolist(), (vocab.keys[:-1] & (1 << 20) - 1).tolist(), vocab.ranks[:-1].tolist())
    found = [vocab.decoder[a] + vocab.decoder[b] for a, b, r in pairs if r < max(a, b)]
    assert len(found) > 10_000
    words = [*found, *(x + x for x in found), *(x + y for x, y in zip(found, found[7:]))]
    runs, counts = bpe.replay(vocab, words)
    for word, own in zip(words, np.split(runs, np.cumsum(counts)[:-1])):
        assert own.tolist() == REF._core_bpe.encode_single_piece(word)


def test_neighbouring_merges_of_one_step_hide_a_lower_pair():
    tokens = [bytes([b]) for b in range(256)] + [b"bab", b"ba"]
    vocab = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    assert bpe.replay(vocab, [b"baba"])[0].tolist() == vocab.one_by_one(b"baba") == [256, 97]


def test_memory_of_one_long_word():
    """Working arrays stay near 40 bytes for each byte of the longest word."""
    import random
    import tracemalloc

    word = "".join(random.Random(3).choices("etaoinshrdlu", k=1_000_000)).encode()
    vocab = bpe._vocabulary(DATA)
    tracemalloc.start()
    runs, _ = bpe.replay(vocab, [word])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(map(vocab.decoder.__getitem__, runs.tolist())) == word and most < 60 * len(word)


def test_repeated_rows_and_one_pass(spark):
    df = spark.createDataFrame([(1, "twice the same"), (1, "twice the same"), (2, None)], "doc_id long, text string")
    both = bpe.encode(df, PATH, P.PATTERN, decoded="decoded")
    apart = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH)
    assert sorted(both.collect(), key=str) == sorted(apart.collect(), key=str)
