"""Byte-level BPE against the tiktoken library and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from rateweave.llm import bpe
from rateweave.llm.bpe import Codec, read_vocabulary

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  ", "a", "'s 's''ll I'll", "\n\n \n x", "a  b", "été  à\tl'été\r\n", "日本語のテキスト。", "🙂🙂 👍🏽",
       "x\x00y\x1cz \x1c w", "1234567 12,345.67", "<|endoftext|> a", "don't  stop \n", " lead", "trail ", "  a  ",
       "a" * 700, "ab" * 400 + " " * 300 + "é" * 300]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(read_vocabulary(PATH), P.PATTERN)


def mixed(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(["the ", " in", "tion", "é", "ü", " ", "\n", "12", "'s", "!", "x", "日", "🙂", "\t", "Th"])
                   for _ in range(n))


def test_same_ids_as_the_library(codec, library):
    texts = ODD + [mixed(i, 60) for i in range(300)] + [mixed(999, 30_000)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), text[:80]
        assert codec.decode(ids.tolist()) == text.encode()


def test_both_tree_layouts_agree(codec):
    pieces = [mixed(i, 12).replace(" ", "").encode()[:64] for i in range(200)]
    pieces = [p for p in pieces if p not in codec.ranks and p]
    width = 64
    together = codec._merge_many(pieces, width)
    for piece, ids in zip(pieces, together):
        assert ids == bpe.np.array(codec._merge_long(piece), bpe.np.int32).tobytes()


def test_long_piece_is_not_slow(codec, library):
    text = "thonble" * 3_000
    assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_rows(spark, documents, library):
    rows = [(1, "The same text."), (1, "The same text."), (None, "no id"), (2, None), (3, ""), (4, mixed(5, 5_000))]
    docs = documents(rows, extra=True)
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, P.PATTERN).collect()), key=repr)
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bpe.decoded(bpe.encoded(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted((bytes(r.data) for r in back.collect())) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(documents([]), PATH, P.PATTERN).count() == 0
