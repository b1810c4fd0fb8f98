import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from llm.bpe import MergeReplay, encode_documents, encoder, read_ranks
from tests.llm.helpers import AWKWARD, documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows_equal_the_library(spark, library, clashing):
    got = encode_documents(documents(spark, clashing=clashing), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(AWKWARD)
    want = sorted((i, tuple(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in AWKWARD if i is not None)
    assert sorted((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in got if r["doc_id"] is not None) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(r['ids'])}I", *r["ids"])).hexdigest()


def test_empty_table(spark):
    assert encode_documents(documents(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


def test_random_texts_equal_the_library(library):
    bpe, draw = encoder(PATH, public_tokenizers.PATTERN), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t ", "'s", "'re", "é", "２", "　", "\x85", "\x1c", "​", "日", "\U0001f642", "!?", "ing", " \n ", "\r\n", "123", "<|endoftext|>"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(800)]
    texts += ["".join(draw.choice("etaoinshr") for _ in range(draw.randint(60, 300))) for _ in range(100)]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_merges_whose_result_has_a_lower_rank_than_its_parts():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"abc": 1, b"bc": 3, b"cab": 2, b"ab": 9, b"bca": 4, b"aa": 6, b"aab": 5}
    library = tiktoken.Encoding("odd", pat_str=r"[a-c]+", mergeable_ranks=ranks, special_tokens={})
    replay, draw = MergeReplay(ranks), random.Random(5)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 90))) for _ in range(400)})
    want = [library.encode_ordinary(w) for w in words]
    assert [list(struct.unpack(f"<{len(i) // 4}I", i)) for i in replay.words([w.encode() for w in words])] == want


@pytest.mark.parametrize("seed", range(6))
def test_random_vocabularies_equal_the_library(seed):
    """Merges that overlap, wait for lower ranks and are made of one another in several ways."""
    draw = random.Random(seed)
    tokens = {"a", "b", "c"}
    while len(tokens) < 60:
        tokens.add((draw.choice(sorted(tokens)) + draw.choice(sorted(tokens)))[:7])
    order = sorted(t for t in tokens if len(t) > 1)
    draw.shuffle(order)
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {t.encode(): k for k, t in enumerate(order)}
    library = tiktoken.Encoding("random", pat_str=r"[a-c]+", mergeable_ranks=ranks, special_tokens={})
    words = sorted({"".join(draw.choice(draw.choice(["abc", "a", "ab"])) for _ in range(draw.randint(1, 60))) for _ in range(600)} - tokens)
    got = [list(struct.unpack(f"<{len(i) // 4}I", i)) for i in MergeReplay(ranks).words([w.encode() for w in words])]
    assert got == [library.encode_ordinary(w) for w in words]


def test_very_long_words():
    words = [b"a" * 300_000, b"ab" * 100_000, b"\xff" * 1000, b"x"]
    tokens = {v: k for k, v in read_ranks(PATH).items()}
    got = [struct.unpack(f"<{len(i) // 4}I", i) for i in MergeReplay(read_ranks(PATH)).words(words)]
    assert [b"".join(tokens[i] for i in ids) for ids in got] == words and len(got[0]) < 100_000
