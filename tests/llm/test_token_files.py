"""Token files: grammars expand to what they came from, files hold the library's ids in order."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_bpe import ODD, mixed
from tokenizers import Tokenizer

from rateweave.llm import token_files
from rateweave.llm.common import scratch

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("ids", [
    np.array([], int), np.array([5]), np.zeros(1000, int), np.tile([1, 2, 3], 500), np.tile([1, 1, 2], 700),
    np.random.default_rng(1).integers(0, 12, 20_000), np.random.default_rng(2).zipf(1.3, 20_000) % 5_000])
def test_grammar_round_trip(ids):
    symbols, rules, sizes = token_files.compress(ids, 5_000)
    assert token_files.expand(symbols, rules, sizes, 5_000).tolist() == ids.tolist()
    if len(ids) > 1 and len(set(ids.tolist())) > 1:
        assert len(symbols) < len(ids)


def rows():
    out = [(100 - i, t) for i, t in enumerate(ODD)]
    out += [(200 + i, mixed(i, 300)) for i in range(40)]
    return out + [(5, "again"), (5, "again"), (5, "other"), (None, "no id"), (6, None), (7, "<|endoftext|> x"), (8, mixed(1, 9_000))]


@pytest.mark.parametrize("shard_ids", [50, 3_000, 10**6])
def test_files_hold_the_ids_in_order(spark, documents, shard_ids):
    library = Tokenizer.from_file(PATH)
    got = token_files.round_trip(documents(rows(), extra=True), PATH, shard_ids=shard_ids).collect()
    want, start = [], 0
    order = spark.createDataFrame([(t or "",) for _, t in rows()], "t string").distinct().select("t", F.xxhash64("t").alias("h"))
    hashed = {r.t: r.h for r in order.collect()}
    for i, t in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_random_access(spark, documents):
    library = Tokenizer.from_file(PATH)
    folder = scratch(spark, "test-token-files")
    token_files.write(documents(rows()), folder, PATH, shard_ids=2_000)
    wanted = spark.createDataFrame([(8,), (210,), (6,), (12345,)], "doc_id long")
    got = {r.doc_id: r.ids for r in token_files.lookup(spark, folder, wanted).collect()}
    texts = dict(rows())
    assert got == {i: library.encode(texts[i] or "", add_special_tokens=False).ids + [2] for i in (8, 210, 6)}


def test_empty_table(documents):
    assert token_files.round_trip(documents([]), PATH).count() == 0


@pytest.mark.parametrize("pattern", [[7], [1, 2], [1, 2, 3, 4], [3, 3, 9]])
def test_repetition_takes_a_logarithmic_number_of_symbols(pattern):
    ids = np.tile(pattern, 1_000_000 // len(pattern))
    symbols, rules, sizes = token_files.compress(ids, 5_000)
    assert len(symbols) < 100 and len(rules) < 60
    assert token_files.expand(symbols, rules, sizes, 5_000).tolist() == ids.tolist()


def test_runs_of_odd_lengths():
    rng = np.random.default_rng(4)
    ids = np.repeat(rng.integers(0, 6, 3_000), rng.integers(1, 12, 3_000))
    symbols, rules, sizes = token_files.compress(ids, 50)
    assert token_files.expand(symbols, rules, sizes, 50).tolist() == ids.tolist()
    assert any(a == b for a, b in rules.tolist()) and len(symbols) < len(ids) / 3


def test_remembered_answers_outlive_a_generation(monkeypatch):
    from rateweave.llm import pretokens

    monkeypatch.setattr(pretokens, "GENERATION", 10)
    asked = []
    kept = pretokens.Remembered(lambda c: asked.append(c) or c.upper())
    for n in range(100):
        assert kept["often"] == "OFTEN" and kept[f"w{n}"] == f"W{n}"
        kept.turn()
    assert asked.count("often") == 1 and len(kept) + len(kept.before) <= 24


def test_cuts_of_texts_with_odd_spaces():
    from rateweave.llm.pretokens import LibraryIds

    data = open(PATH, "rb").read()
    ours, library = LibraryIds(data), Tokenizer.from_str(data.decode())
    texts = ["", " ", "One two, three. (four) five! six? .. , it's; 7, a7. ä, 语。 语, x:", "a", " a", "a ", "a  b", "  a b", "a b  ", "a \t b", "a \n", "a b c", "a  b", "a 　b", "x " * 50, "'s 's  's"]
    for text, ids in zip(texts, ours.encode(texts)):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
