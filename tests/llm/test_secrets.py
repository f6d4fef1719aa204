"""Secrets: strict spans against plain patterns, the chains on held-out samples, odd rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from rateweave.llm import secrets

NAME = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)
                        for name in ("password", "passwd", "secret", "token", "api_?key")) + ")"
PATTERNS = [(NAME + r"""["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32)]


def plain(text):
    out = []
    for kind, (pattern, group, least) in enumerate(PATTERNS):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def test_strict_spans_as_by_plain_patterns():
    r = random.Random(5)
    bits = ["password", "PassWd", "secret", "ſecret", "toKen", "token", "api_key", "APIKEY", "apiKey", "=", ":", " ", "'", '"', "  ",
            "AKIA", "IA7", "A1B2C3D4E5F6", "deadbeef", "0123456789abcdef", "abcdefgh", "x", "é", "\n", "/", "==", "-", ".", "12345678", "Z"]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 12)))
        assert secrets.base_spans(text) == plain(text), text


@pytest.mark.parametrize("unit", ["token", "token ", "token=", "AKIA", "a", "deadbeef ", "=", " ", "token: ", "secret'", "a/"])
def test_time_grows_with_length_only(unit):
    text = unit * (400_000 // len(unit))
    start = time.time()
    secrets.base_spans(text)
    assert time.time() - start < 10


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(4)
    syllables = ["ta", "ri", "mon", "el", "sha", "con", "ter", "in", "ge", "ption", "ver", "us", "ble", "ly", "or"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 5))) for _ in range(800)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(80))) for i in range(60)], "doc_id long, text string")
    return secrets.fit(docs)


def test_held_out_samples(model):
    assert model["false_positives"] <= 0.005
    assert min(model["recall"].values()) >= 0.9, model["recall"]


def test_fresh_strings(model):
    r = np.random.default_rng(99)
    drawn = [s for _, s in secrets.random_samples(r, 2_000) if len(s) >= 24]
    assert (secrets.ratios(drawn, model["ordinary"], model["random"]) >= model["threshold"]).mean() > 0.95
    names = ["getElementsByTagName", "the_quick_brown_fox_jumps", "src/main/java/org/example", "2024-11-12-release-notes",
             "aaaaaaaaaaaaaaaaaaaaaaaa", "--------------------------", "12345678901234567", "MAXIMUM_NUMBER_OF_RETRIES"]
    assert (secrets.ratios(names, model["ordinary"], model["random"]) < model["threshold"]).all()


def test_ratios_by_hand():
    samples = ["abab", "abba"]
    table = secrets.Chain(samples).table
    size = secrets.START + 1
    a, b = secrets.TOKEN.index("a"), secrets.TOKEN.index("b")
    steps = [(secrets.START, secrets.START, a), (secrets.START, a, b), (a, b, b)]
    want = -sum(float(table[(x * size + y) * secrets.START + z]) for x, y, z in steps)
    flat = np.zeros((2, len(table)), np.float32)
    got = secrets.ratios(["abb", "abb"], table, flat)
    assert got == pytest.approx([want, want])
    each = np.exp(table.reshape(size, size, secrets.START)).sum(axis=2)
    assert each == pytest.approx(np.ones((size, size)), abs=1e-4)


KEY = "q7Zk2LmX9vB4nT8sWc3RyP6d"


def test_rows(documents, model):
    rows = [(1, f'é secret_name token = "{KEY}" and {KEY} end'), (1, f'é secret_name token = "{KEY}" and {KEY} end'),
            (None, "deadbeef" * 4), (2, None), (3, ""), (4, "nothing here but plain_names_of_things"), (5, "AKIA" + "Q7" * 8),
            (6, f"{KEY}"), (7, "word " * 60_000 + KEY), (8, "password: hunter2"), (9, "a" * 200_000)]
    got = sorted(map(tuple, secrets.found(documents(rows, extra=True).repartition(3), model).collect()), key=repr)
    assert len(got) == len(rows)
    for i, *counts, sha, spans, n_added in got:
        t = next(t for j, t in rows if i == j) or ""
        base = plain(t)
        assert counts == [sum(k == kind for _, kind, _ in base) for k in range(3)]
        names = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert sha == hashlib.sha256(names.encode()).hexdigest()
        assert set(filter(None, names.split(","))) <= set(spans.split(","))
        added = [tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s.startswith(secrets.ADDED)]
        assert n_added == len(added) == {1: 1, 6: 1, 7: 1}.get(i, 0)
        assert all(t[a:b] == KEY and all(e <= a or s >= b for s, _, e in base) for a, b in added)
    assert secrets.found(documents([]), model).count() == 0


def test_neighbouring_texts_do_not_mix(documents, model):
    rows = [(i, t) for i, t in enumerate(["pass", "word=12345678", "x" + KEY[:12], KEY[12:], "", "tok", "en: abcdefghijk"] * 5)]
    got = secrets.found(documents(rows).coalesce(1), model).collect()
    assert all(r.spans == "" for r in got)


def test_fit_without_text(documents):
    assert secrets.fit(documents([(1, None)]))["threshold"] >= 0
