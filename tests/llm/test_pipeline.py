"""The pipeline, stage by stage, against plain versions over a small table."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from test_decontaminate import by_hand as hits_by_hand
from test_neardup import by_hand as groups_by_hand
from test_pii import plain

import corpus_pipeline
from rateweave.llm import pii

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = corpus_pipeline.saved(stage(spark, docs, SF), name)
        out.append((before, [r.asDict() for r in docs.collect()]))
    return out


def test_columns_and_lengths(stages):
    for _, after in stages[:-1]:
        assert after and all(list(r) == COLUMNS and r["n_chars"] == len(r["text"]) for r in after)


def test_quality_keeps_clean_rows(stages):
    before, after = stages[0]
    old, new = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"]: r["text"] for r in after}
    assert new.keys() < old.keys()
    for i, text in new.items():
        lines = old[i].split("\n")
        assert text == old[i] or set(text.split("\n")) < set(lines)
        assert len(text.split()) * 2 > len(old[i].split()) >= 20


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    label = groups_by_hand([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == set(label.values()) < set(label)


def test_no_passage_is_left(stages, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages[2]
    hit = {x[0]: x[2] / x[1] for x in hits_by_hand([(r["doc_id"], r["text"]) for r in before], items) if x[2]}
    assert hit
    left = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        share = hit.get(r["doc_id"])
        assert (r["doc_id"] in left) == (share is None or share <= 0.3)
        assert share or left[r["doc_id"]] == r["text"]


def test_no_strict_span_is_left(stages):
    before, after = stages[3]
    old = {r["doc_id"]: r["text"] for r in before}
    assert old.keys() == {r["doc_id"] for r in after}
    assert any(plain(t) for t in old.values())
    for r in after:
        assert not pii.base_spans(r["text"])
        if not plain(old[r["doc_id"]]) and not pii.candidates(old[r["doc_id"]]):
            assert r["text"] == old[r["doc_id"]]


def test_tokens(stages, spark):
    before, after = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before:
        ids = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(r["text"].encode()).hexdigest()))
    assert sorted(tuple(r.values()) for r in after) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
