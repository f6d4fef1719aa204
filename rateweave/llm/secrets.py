"""Secrets: strict rules, and character Markov models of random strings held against one of ordinary identifiers.

Spans that pass a strict rule (``base_spans``) always stay. Beyond them every maximal run of token characters is a
candidate. Its characters are scored by two kinds of Markov chains: one of ordinary identifiers (words, compounds, paths,
versions, numbers), and one for each alphabet that random strings are drawn from. The log-likelihood ratio of the best
mixture of random chains against the ordinary chain, summed over the run, decides: a span is added where it reaches a
threshold. The chains are trained from labelled samples, of which a part is held out to set the threshold.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.llm.bpe import arrow_type
from rateweave.llm.common import text_sample

#: Kinds of strict spans, and the kind of an added one.
KINDS = ("assign", "access", "hex")
ADDED = "random"

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Characters of candidates, and the least and most characters that are looked at as one candidate's chain.
TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}")
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[list(TOKEN.encode())] = True
#: Place of a byte among the chains' symbols; the last symbol stands for the start.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(TOKEN.encode())] = np.arange(len(TOKEN))
START = len(TOKEN)


# --- strict rules ---

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of everything that passes a strict rule, in order; kinds are places in ``KINDS``.

    A key's name may be in either case, and ASCII only: look-alikes of other scripts are no names. Time is in proportion
    to the length.
    """
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a run shorter than 32 has no part of 32, so asking for the length at once drops just the failing runs
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


# --- the chains ---

#: What kind of character a symbol is: small letter, capital, digit, mark, start.
_SHAPE = np.array([1 if c.isupper() else 0 if c.islower() else 2 if c.isdigit() else 3 for c in TOKEN] + [4])


class Chain:
    """A second-order Markov chain over the token characters, backed off to lower orders; plain arrays inside.

    With a share of ``general`` each step goes by the kinds of the last two characters only (letters, capitals, digits,
    marks), so that names made of letters are ordinary even where the samples know other languages.
    """

    def __init__(self, samples: list[str], general: float = 0.0, smoothing: float = 0.5, weight: float = 8.0):
        size = START + 1
        codes, first = _codes(samples)
        earlier, before = _history(codes, first)
        ones = np.bincount(codes, minlength=START) + smoothing
        ones /= ones.sum()
        pairs = np.bincount(before * START + codes, minlength=size * START).reshape(size, START)
        twos = (pairs + weight * ones) / (pairs.sum(axis=1, keepdims=True) + weight)
        triples = np.bincount((earlier * size + before) * START + codes, minlength=size * size * START).reshape(size, size, START)
        steps = (triples + weight * twos[None]) / (triples.sum(axis=2, keepdims=True) + weight)
        if general:
            kinds = np.bincount((_SHAPE[earlier] * 5 + _SHAPE[before]) * 4 + _SHAPE[codes], minlength=100).reshape(5, 5, 4) + smoothing
            kinds = kinds / kinds.sum(axis=2, keepdims=True)
            kind = _SHAPE[:START]
            within = ones / np.bincount(kind, ones)[kind]
            steps = (1 - general) * steps + general * kinds[_SHAPE][:, _SHAPE][:, :, kind] * within
        self.table = np.log(steps).astype(np.float32).ravel()


def _history(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last symbol but one and the last symbol before every place."""
    second = np.zeros(len(first), bool)
    second[1:] = first[:-1]
    before = np.where(first, START, np.r_[START, codes[:-1]])
    return np.where(first | second, START, np.r_[START, START, codes[:-2]][:len(codes)]), before


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all strings, one after the other, and where a string starts."""
    codes = _SYMBOL[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
    first = np.zeros(len(codes), bool)
    lengths = np.array([len(s) for s in strings], np.int64)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return codes, first


def ratios(strings: list[str], ordinary: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Log-likelihood of the even mixture of ``random`` chains over that of the ``ordinary`` one, for every string.

    ``ordinary`` is a chain's table, ``random`` one table a row. No string is empty.
    """
    if not strings:
        return np.empty(0)
    size = START + 1
    codes, first = _codes(strings)
    earlier, before = _history(codes, first)
    at = (earlier * size + before) * START + codes
    starts = np.flatnonzero(first)
    by_chain = np.stack([np.add.reduceat(table[at].astype(np.float64), starts) for table in random])
    best = by_chain.max(axis=0)
    mixture = best + np.log(np.exp(by_chain - best).mean(axis=0))
    return mixture - np.add.reduceat(ordinary[at].astype(np.float64), starts)


# --- labelled samples ---

#: Alphabets of random strings; each has a chain of its own.
ALPHABETS = {
    "lower hex": "0123456789abcdef",
    "upper hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64 for urls": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: How much of an ordinary string's chance goes by kinds of characters only.
GENERAL = 0.3
#: Marks that services put before their keys; a chain sees them as the start of a random string.
MARKS = ("", "", "", "sk_live_", "pk_test_", "ghp_", "xoxb-", "glpat-", "key-", "AIza", "npm_", "SG")


def random_samples(r: np.random.Generator, n: int) -> list[tuple[str, str]]:
    """``(alphabet, string)``: random strings of 16 to 64 characters, some behind a mark."""
    names = list(ALPHABETS)
    out = []
    for _ in range(n):
        name = names[r.integers(len(names))]
        letters = ALPHABETS[name]
        body = "".join(letters[i] for i in r.integers(0, len(letters), r.integers(LEAST, 65)))
        out.append((name, MARKS[r.integers(len(MARKS))] + body))
    return out


def ordinary_samples(r: np.random.Generator, words: list[str], n: int) -> list[str]:
    """Identifiers as people write them: long words and compounds of ``words``, paths, versions, dates and numbers."""
    words = words or ["name"]

    def word():
        return words[r.integers(len(words))]

    def number(most):
        return "".join(map(str, r.integers(0, 10, r.integers(1, most + 1))))

    def one(*of):
        return of[r.integers(len(of))]()

    def compound(join, form):
        return join.join(form(word()) for _ in range(r.integers(2, 7)))

    out = []
    while len(out) < n:
        s = one(lambda: compound("_", str.lower), lambda: compound("-", str.lower), lambda: compound("", str.capitalize),
                lambda: compound("_", str.upper), lambda: "/".join(compound("-", str.lower) for _ in range(r.integers(1, 4))),
                lambda: compound("/", str), lambda: word() + word(), lambda: compound("", str.lower),
                lambda: number(20) + number(20), lambda: number(20) + number(20), lambda: number(24) + number(24),
                lambda: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}-{compound('-', str.lower)}",
                lambda: compound("_", str.lower) + "_" + number(4), lambda: compound("", str.capitalize) + number(3),
                lambda: number(8) + "-" + number(8), lambda: word() * int(r.integers(2, 6)),
                lambda: TOKEN[r.integers(len(TOKEN))] * int(r.integers(LEAST, 80)))
        if len(s) >= LEAST:
            out.append(s)
    return out


def fit(docs: DataFrame, text: str = "text", snippets: int = 2_000, characters: int = 2_000, examples: int = 40_000,
        false_share: float = 1e-3, seed: int = 11) -> dict:
    """The model as plain values: ``ordinary``, ``random`` (tables), ``threshold``, and figures on held-out samples.

    Bounds: ``snippets`` pieces of at most ``characters`` characters, chosen by a hash of the text over all rows, reach the
    driver. Their words and ``examples`` compounds of them are the ordinary samples; as many random strings come from a
    seeded generator. Half of each trains the chains; on the other half the threshold is set so that at most
    ``false_share`` of ordinary samples reach it. ``false_positives`` and ``recall`` (by alphabet) are measured on a third
    draw. An empty table has no words, and the samples then know numbers and one word only.
    """
    pieces = text_sample(docs, text, snippets, characters)
    words = sorted({w for piece in pieces for w in re.findall("[A-Za-z]{2,}", piece)})
    r = np.random.default_rng(seed)
    long_words = [w for w in words if len(w) >= LEAST]

    def draw(n):
        return ordinary_samples(r, words, n) + long_words, random_samples(r, n)

    ordinary, drawn = draw(examples // 2)
    chain = Chain(ordinary + [w for w in words if len(w) >= 5], GENERAL).table
    random = np.stack([Chain([s for a, s in drawn if a == name]).table for name in ALPHABETS])
    plain, drawn = draw(examples // 2)
    threshold = max(0.0, float(np.quantile(ratios(plain, chain, random), 1 - false_share, method="higher"))) + 1e-6
    plain, drawn = draw(examples // 2)
    reached = ratios([s for _, s in drawn], chain, random) >= threshold
    recall = {name: float(reached[[a == name for a, _ in drawn]].mean()) for name in ALPHABETS}
    return {"ordinary": chain, "random": random, "threshold": threshold,
            "false_positives": float((ratios(plain, chain, random) >= threshold).mean()), "recall": recall}


# --- the operator ---

#: Characters of candidates that are scored at once.
SCORED = 2_000_000


def _worth_a_look(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every text of a batch: does it have a run of token characters long enough, or a key's name?"""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_TOKEN[data]
    # runs end where a text does
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= LEAST
    marked = np.zeros(len(offsets), bool)  # the last place takes what lies behind all texts
    # a run over several texts marks all of them, which costs a look only
    first = np.searchsorted(offsets, starts[long], side="right") - 1
    last = np.searchsorted(offsets, ends[long] - 1, side="right") - 1
    marked[first] = True
    marked[last] = True
    for a, b in zip(first[last > first + 1].tolist(), last[last > first + 1].tolist()):
        marked[a:b] = True
    low = data.tobytes().lower()
    for cue in _CUES:
        at = low.find(cue)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, side="right")) - 1
            marked[text] = True
            at = low.find(cue, max(at + 1, int(offsets[text + 1]) if text + 1 < len(offsets) else at + 1))
    return marked[:-1]


def _added(texts: list[str], base: list[list], model: dict) -> list[list[tuple[int, int]]]:
    """For every text the runs that reach the threshold and touch no strict span."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    waiting, strings, held = [], [], 0

    def score():
        nonlocal held
        reached = ratios(strings, model["ordinary"], model["random"]) >= model["threshold"]
        for k in np.flatnonzero(reached).tolist():
            i, a, b = waiting[k]
            out[i].append((a, b))
        waiting.clear()
        strings.clear()
        held = 0

    for i, t in enumerate(texts):
        strict, k, reach = base[i], 0, 0
        for m in _CANDIDATE.finditer(t):
            a, b = m.span()
            while k < len(strict) and strict[k][0] < b:
                reach = max(reach, strict[k][2])
                k += 1
            if reach > a:
                continue
            waiting.append((i, a, b))
            strings.append(m.group())
            held += b - a
            if held >= SCORED:
                score()
    if strings:
        score()
    return out


def listed(base: list, added: list = ()) -> str:
    """Spans as ``kind:start:end``, by start, strict kinds first."""
    spans = sorted([(a, k, b) for a, k, b in base] + [(a, len(KINDS), b) for a, b in added])
    return ",".join(f"{(*KINDS, ADDED)[k]}:{a}:{b}" for a, k, b in spans)


def found(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_assign, n_access, n_hex, base_sha256, spans, n_added)`` for every row of ``docs``.

    Counts and ``base_sha256`` are over the strict spans, ``spans`` lists all; positions are code points, ends exclusive.
    An added span never touches a strict one. A null text is an empty one and has no spans. Whole texts are searched, in
    time that grows with their length. Rows do not influence each other, so repeated rows and null keys come out as they
    went in; an empty table gives an empty table; other columns are ignored.
    """
    # arrays and plain values: workers need numpy and pyarrow, not this package
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            n = len(column)
            if not n:
                continue
            if column.type != pa.string() or column.null_count:
                column = column.cast(pa.string()).fill_null("")
            _, places, bytes_ = column.buffers()
            offsets = np.frombuffer(places, np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
            data = np.frombuffer(bytes_, np.uint8)[offsets[0]:offsets[-1]] if bytes_ is not None else np.empty(0, np.uint8)
            rows = np.flatnonzero(_worth_a_look(data, offsets - offsets[0])).tolist()
            texts = [column[i].as_py() for i in rows]
            base = [base_spans(t) for t in texts]
            added = _added(texts, base, shared.value)
            spans, digests = [""] * n, [hashlib.sha256(b"").hexdigest()] * n
            counts, more = np.zeros((len(KINDS), n), np.int64), np.zeros(n, np.int64)
            for i, strict, others in zip(rows, base, added):
                if strict or others:
                    spans[i] = listed(strict, others)
                    digests[i] = hashlib.sha256(listed(strict).encode()).hexdigest()
                    more[i] = len(others)
                    for _, k, _ in strict:
                        counts[k, i] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow_type(kind)), *map(pa.array, counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(more)],
                names=[key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(key, F.col(text).cast("string")).mapInArrow(
        run, f"`{key}` {kind}, {counts}, base_sha256 string, spans string, n_added bigint")
