"""Personal data: strict spans against plain patterns, trees on held-out examples, odd rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from rateweave.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [c for c in m.group() if c in "0123456789"]
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == 2 and 14 <= len(digits) <= 19 and pii.luhn("".join(digits))
                    or kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_strict_spans_as_by_plain_patterns():
    r = random.Random(1)
    bits = ["a", "b.c", "@", "x@y.z", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111",
            "+1 (203) 555-8282", "é", "\n", "12.34.56.78", "%", "..", "@a.b", "007"]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("unit", ["1", "1.", "+", "+1 ", "a@", "a", "1 ", "(at)", "[at]a.b", "+1()", "("])
def test_time_grows_with_length_only(unit):
    text = unit * (400_000 // len(unit))
    start = time.time()
    pii.base_spans(text)
    pii.candidates(text)
    assert time.time() - start < 10


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(4_000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = pii.Trees(x[:3_000], y[:3_000])
    assert ((trees.probability(x[3_000:]) > 0.5) == y[3_000:]).mean() > 0.95


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"word{r.randrange(99)}" for _ in range(80))) for i in range(50)], "doc_id long, text string")
    return pii.fit(docs)


def test_held_out_precision(model):
    assert model.held_out_precision >= 0.95
    assert sum(t <= 1 for t in model.thresholds) >= 2


def test_rows(documents, model):
    text = "é mail me at a.b@c-d.example.com or 1.2.3.4, +1 (203) 555-8282; 4111 1111 1111 1111"
    rows = [(1, text), (1, text), (None, "x@y.z"), (2, None), (3, ""), (4, "no data here 12"), (5, "1.2.3.4.5.6.7.8 " * 5_000)]
    got = sorted(map(tuple, pii.found(documents(rows, extra=True), model).collect()), key=repr)
    assert len(got) == len(rows)
    for i, *counts, sha, spans, n_added in got:
        t = next(t for j, t in rows if i == j) or ""
        base = plain(t)
        assert counts == [sum(k == kind for _, kind, _ in base) for k in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert sha == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(spans.split(","))
        assert n_added == (len(spans.split(",")) if spans else 0) - len(base)
    assert pii.found(documents([]), model).count() == 0


def test_redaction(documents, model):
    rows = [(1, "write to a@b.cd now"), (2, None), (3, "clean text 3.14"), (4, "call (203) 555-8282 today")]
    got = {r.doc_id: r.text for r in pii.redacted(documents(rows), model).collect()}
    assert got[1] == "write to [EMAIL] now" and got[2] is None and got[3] == "clean text 3.14"
    assert got[4] in ("call [PHONE] today", rows[3][1])


def test_fit_without_text(documents):
    assert pii.fit(documents([(1, None)])).thresholds


@pytest.mark.parametrize("parts", [("7536784127813050", "4845168114407329"), ("4550997810720808", "4111111111111111", "5500005555555559"),
                                   ("(212) 555-1234", "(646) 555-9876"), ("4111.1111.1111.1111", "12/26"), ("2023", "212-555-1234")])
def test_numbers_side_by_side(documents, model, parts):
    text = f"we had {' '.join(parts)} there"
    places = [(text.index(x), text.index(x) + len(x)) for x in parts if sum(map(str.isdigit, x)) >= 7]
    assert set(places) <= {(a, b) for a, _, b in pii.candidates(text)}
    (got,) = pii.redacted(documents([(1, text)]), model).collect()
    assert not any(text[a:b] in got.text for a, b in places)
    assert got.text.startswith("we had ") and got.text.endswith(" there")
    assert got.text.count("[") == len(places)
