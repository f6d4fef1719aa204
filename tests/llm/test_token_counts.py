"""Token counts and chunk-wise ids against the tokenizers library on whole texts."""

import public_tokenizers as P
import pytest
from test_bpe import ODD, mixed
from tokenizers import Tokenizer

from rateweave.llm import token_counts
from rateweave.llm.bpe import read_vocabulary
from rateweave.llm.pretokens import LibraryIds

PATH = P.path("byte_bpe_50k.json")
TEXTS = ODD + ["a  <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext |>", "tab\tthen  two\x7f \x00\x01 z", "a  b  c"]
TEXTS += [mixed(i, 80) for i in range(200)] + [mixed(77, 20_000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_chunks_give_the_ids_of_whole_texts(library):
    got = LibraryIds(read_vocabulary(PATH)).encode(TEXTS)
    for text, ids in zip(TEXTS, got):
        assert memoryview(ids).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("table", [0, 50, 100_000])
def test_counts(documents, library, table):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (5_000, None)]
    got = token_counts.token_counts(documents(rows, extra=True), PATH, table=table)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(documents):
    assert token_counts.token_counts(documents([]), PATH).count() == 0


def test_frequent_chunks_come_first(documents):
    rows = [(i, "x often often often seldom " + f"only{i}") for i in range(300)]
    assert token_counts.frequent_chunks(documents(rows), table=2) == ["often", "seldom"]
