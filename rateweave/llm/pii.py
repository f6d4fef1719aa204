"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select redactions.

Generators aim at recall and may overlap. Spans that pass a kind's strict rule (``base_spans``) always stay. The others,
which strict rules miss (numbers without a country code, obfuscated addresses, cards with a mistyped digit, and the
like), get format and context features and are scored by gradient-boosted trees; a span is added when its score reaches
the threshold of its kind and it is one of the best set of spans without overlap.

No table says which text is personal, so the trees learn from planted examples: look-alikes (order numbers, versions,
dates, prices, hashes) and personal data in many formats, written into contexts taken from the corpus. The contexts are a
bounded sample of rows; examples not used for fitting set the thresholds.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.llm.bpe import arrow_type
from rateweave.llm.common import text_sample

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[(+]?[0-9]++(?:[ ().\-/]{1,2}+[0-9]++)*+")
_GROUP = re.compile(r"[(+]?[0-9]++")
_LEFT = re.compile(r"([0-9]+)([ ().\-/]{1,2})$")
_RIGHT = re.compile(r"([ ().\-/]{1,2})[(+]?([0-9]+)")
_AT = re.compile(r"[\[({<]\s?(?:at|@)\s?[\])}>]", re.IGNORECASE)
_AFTER_AT = re.compile(r"[ ]?[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?[\[({<]\s?(?:dot|\.)\s?[\])}>][ ]?)[A-Za-z0-9-]{1,63})++", re.IGNORECASE)


# --- strict rules ---

def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of everything that passes a strict rule, in order; kinds are places in ``KINDS``.

    The patterns are matched from their rare characters outwards, so that time stays in proportion to the length.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(_is_octet, four)):
                out.append((start, 1, end))
            start = end + 1
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    plus = text.find("+")
    while plus >= 0:
        m = _PHONE.match(text, plus)
        if m and 10 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((plus, 3, m.end()))
        plus = text.find("+", m.end() if m else plus + 1)
    out.sort()
    return out


# --- candidates and features ---

FEATURES = ("length", "digits", "groups", "longest_group", "shortest_group", "dots", "dashes", "blanks", "parens", "slash",
            "plus", "luhn", "octets", "obfuscated", "domain_parts", "last_part", "letter_before", "letter_after",
            "mark_before", "mark_after", "cue_email", "cue_phone", "cue_card", "cue_ip", "cue_other", "kind",
            "first_group", "last_group", "kinds_of_gap", "digits_left", "digits_right", "gap_left", "gap_right", "gap_left_inside",
            "gap_right_inside")
#: Words that stand near personal data, by kind, and near look-alikes.
CUES = (re.compile(r"e-?mail|mailto|write to|correo|courriel|contact", re.I),
        re.compile(r"\b(?:call|phone|tel|mobile|cell|fax|dial|whatsapp|t[eé]l[eé]fono?|telefon)\b", re.I),
        re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte)\b", re.I),
        re.compile(r"\b(?:ip|host|server|address|ping)\b", re.I),
        re.compile(r"\b(?:order|invoice|version|ver|build|isbn|ticket|serial|sku|ref|commit|price|total|page|id|no)\b\.?", re.I))
CONTEXT = 40
MOST_DIGITS = 19


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of spans that may be personal data; they may overlap one another and strict spans.

    Of a run of number groups every stretch of consecutive groups with a plausible number of digits is offered: where
    numbers stand side by side, scores choose the boundaries. A stretch has at most ``MOST_DIGITS`` groups.
    """
    return list(_candidates(text))


def _candidates(text: str):
    for m in _AT.finditer(text):
        start = m.start()
        stop = max(0, start - 65)
        if start > stop and text[start - 1] == " ":
            start -= 1
        first = start
        while start > stop and text[start - 1] in _LOCAL:
            start -= 1
        after = _AFTER_AT.match(text, m.end())
        if start < first and after:
            yield start, 0, after.end()
    for m in _NUMBERS.finditer(text):
        run = m.group()
        if len(run) < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
        sizes = [b - a - (text[a] in "(+") for a, b in groups]
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                n += sizes[j]
                if n > MOST_DIGITS:
                    break
                end = groups[j][1]
                if 7 <= n <= 15:
                    yield start, 3, end
                if n >= 13:
                    yield start, 2, end
                if 3 <= j - i <= 6 and n <= 15 and end - start >= 7 and text.count(".", start, end) == 3:
                    yield start, 1, end


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    groups = re.findall("[0-9]+", span) or [""]
    near = text[max(0, start - CONTEXT):start]
    before, after = text[start - 1:start], text[end:end + 1]
    parts = re.split(r"\.|dot", span.lower())
    gaps = set(re.findall("[^0-9]+", span.lstrip("(+")))
    left = _LEFT.search(text[max(0, start - 2 - MOST_DIGITS):start]) if kind else None
    right = _RIGHT.match(text, end, end + 3 + MOST_DIGITS) if kind else None
    return [len(span), len(digits), len(groups), max(map(len, groups)), min(map(len, groups)), span.count("."), span.count("-"),
            span.count(" "), span.count("("), span.count("/"), span.count("+"), float(luhn(digits)) if digits else 0.0,
            float(len(groups) == 4 and all(map(_is_octet, groups))), float(bool(_AT.search(span))), len(parts), len(parts[-1].strip(" ])}>")),
            float(before.isalnum()), float(after.isalnum()), float(before in "#$€£%&*_" and before != ""),
            float(after in "#$€£%&*_" and after != ""), *[float(bool(c.search(near))) for c in CUES], float(kind),
            len(groups[0]), len(groups[-1]), len(gaps), len(left.group(1)) if left else 0, len(right.group(2)) if right else 0,
            _gap(left.group(2)) if left else 0, _gap(right.group(1)) if right else 0,
            float(bool(left) and left.group(2) in gaps), float(bool(right) and right.group(1) in gaps)]


def _gap(gap: str) -> int:
    return " -./()".find(gap[0]) + 1 + 10 * (len(gap) > 1)


# --- gradient boosting ---

@dataclass(frozen=True)
class Boosting:
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0


class Trees:
    """Boosted regression trees on logistic loss; full binary trees stored level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, how: Boosting = Boosting()):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        self.depth = how.depth
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(how.trees):
            p = 1 / (1 + np.exp(-score))
            slope, bend = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            chosen, at = [], []
            for level in range(how.depth):
                for k in range(2**level):
                    f, b = self._split(binned, slope, bend, node == k, how)
                    chosen.append(f)
                    at.append(cuts[f][b] if b < len(cuts[f]) else np.inf)
                first = 2**level - 1
                f = np.array(chosen[first:])[node]
                node = 2 * node + (x[np.arange(len(y)), f] > np.array(at[first:])[node])
            sums = np.bincount(node, slope, 2**how.depth) / (np.bincount(node, bend, 2**how.depth) + how.ridge)
            score += how.rate * sums[node]
            self.feature.append(chosen)
            self.cut.append(at)
            self.leaf.append(how.rate * sums)

    @staticmethod
    def _split(binned, slope, bend, rows, how):
        best = (0.0, 0, how.bins)
        total, weight = slope[rows].sum(), bend[rows].sum()
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            left = np.cumsum(np.bincount(b, slope[rows], how.bins + 1))[:-1]
            mass = np.cumsum(np.bincount(b, bend[rows], how.bins + 1))[:-1]
            gain = left**2 / (mass + how.ridge) + (total - left)**2 / (weight - mass + how.ridge)
            k = int(gain.argmax())
            gained = gain[k] - total**2 / (weight + how.ridge)
            if gained > best[0] + 1e-9:
                best = (gained, f, k)
        return best[1], best[2]

    def plain(self) -> tuple:
        """The trees as numbers and arrays."""
        return self.start, self.depth, np.array(self.feature), np.array(self.cut), np.array(self.leaf)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _probability(self.plain(), x)


def _probability(trees: tuple, x: np.ndarray) -> np.ndarray:
    start, depth, features_of, cuts, leaves = trees
    score, rows = np.full(len(x), start), np.arange(len(x))
    for feature, cut, leaf in zip(features_of, cuts, leaves):
        node = np.zeros(len(x), int)
        for level in range(depth):
            first = 2**level - 1
            f = feature[first:2 * first + 1][node]
            node = 2 * node + (x[rows, f] > cut[first:2 * first + 1][node])
        score += leaf[node]
    return 1 / (1 + np.exp(-score))


# --- planted examples ---

def _planted_row(r: np.random.Generator) -> tuple[str, str, list[tuple[int, int]]]:
    """A cue, numbers side by side, and where the personal data among them is."""
    def d(n):
        return "".join(map(str, r.integers(0, 10, n)))

    def one(*of):
        return of[r.integers(len(of))]

    def number():
        area, body = str(r.integers(2, 10)) + d(2), str(r.integers(1, 10)) + d(14)
        card = body + next(c for c in "0123456789" if luhn(body + c))
        phones = f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}"
        cards = card, *(gap.join(card[k:k + 4] for k in (0, 4, 8, 12)) for gap in " -.")
        return one(one(*phones), one(*cards))

    def other():
        return one(f"{r.integers(1, 13):02d}/{r.integers(20, 40)}", f"20{d(2)}", f"{r.integers(1, 1000)}", d(5), d(3))

    gap, row, places = one(" ", " ", "  "), "", []
    alike = r.random() < 0.3
    for k in range(r.integers(2, 5)):
        personal = not alike and r.random() < 0.7
        piece = number() if personal else other()
        row += gap * bool(k)
        if personal:
            places.append((len(row), len(row) + len(piece)))
        row += piece
    return one("call ", "phone: ", "card ", "", "", ""), row, places


def _planted(r: np.random.Generator) -> tuple[str, str, int]:
    """A cue (or none), a text and 1 for personal data, 0 for a look-alike."""
    def d(n):
        return "".join(map(str, r.integers(0, 10, n)))

    def one(*of):
        return of[r.integers(len(of))]

    def card(good):
        body = one("4", "5", "3") + d(14)
        digit = next(c for c in "0123456789" if luhn(body + c) == good)
        return body + digit

    name = "".join(map(chr, r.integers(97, 123, r.integers(3, 9))))
    site = "".join(map(chr, r.integers(97, 123, r.integers(4, 9))))
    area = str(r.integers(2, 10)) + d(2)
    good = [
        ("", f"{name}{one(' [at] ', '(at)', '[at]', ' (AT) ')}{site}{one('.', ' [dot] ', '[dot]')}{one('com', 'org', 'net', 'de')}"),
        (one("call ", "phone: ", "tel. ", "mobile "), one(f"({area}) 555-{d(4)}", f"{area}-555-{d(4)}", f"{area}.555.{d(4)}",
                                                         f"0{d(2)}/{d(7)}", f"00{d(2)} {d(3)} {d(7)}")),
        ("", f"({area}) 555-{d(4)}"),
        (one("card ", "visa ", "credit card: "), (lambda c: f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")(card(True))),
        (one("IP ", "host ", "server "), f"{r.integers(1, 255)}.{r.integers(0, 255)}.{r.integers(0, 255)}.{r.integers(1, 255)}"),
    ]
    bad = [
        (one("order ", "invoice ", "ticket ", "ref ", "", ""), one(d(8), d(10), d(13), card(False), f"{d(4)}-{d(6)}")),
        (one("version ", "build ", ""), f"{r.integers(0, 30)}.{r.integers(0, 30)}.{r.integers(256, 9000)}.{r.integers(0, 99999)}"),
        ("", one(f"20{d(2)}-{r.integers(10, 13)}-{r.integers(10, 29)}", f"{r.integers(10, 29)}.{r.integers(10, 13)}.20{d(2)}")),
        (one("isbn ", "serial "), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
        (one("total ", "price ", "page "), one(f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)}", d(7))),
        ("", one(d(16), d(14), f"{d(3)} {d(3)} {d(3)}")),
        ("", f"look{one('(at)', '[at]')}this"),
    ]
    personal = r.random() < 0.5
    cue, text = one(*good) if personal else one(*bad)
    return cue, text, int(personal)


@dataclass(frozen=True)
class Model:
    trees: Trees
    thresholds: tuple[float, ...]  # by kind; above 1: never add
    held_out_precision: float

    def plain(self) -> tuple:
        """What workers need, as numbers and arrays: they may lack this package."""
        return self.trees.plain(), self.thresholds


def fit(docs: DataFrame, text: str = "text", contexts: int = 500, examples: int = 6_000, precision: float = 0.98,
        seed: int = 7) -> Model:
    """Trees and thresholds from planted examples in at most ``contexts`` contexts of the corpus.

    A third of the examples are rows of numbers side by side, in which only the exact ends of a number are right.
    Bounds: ``contexts`` snippets of at most 240 characters reach the driver, chosen by a hash of their text, and
    ``examples`` planted spans are scored. A kind's threshold is the least with at least ``precision`` on a third of the
    examples that the trees have not seen; a kind that cannot reach it is never added.
    """
    snippets = sorted(text_sample(docs, text, contexts, 240)) or [" "]
    r = np.random.default_rng(seed)
    xs, ys, kinds = [], [], []
    for _ in range(examples):
        snippet = snippets[r.integers(len(snippets))]
        if r.random() < 1 / 3:
            cue, planted, places = _planted_row(r)
        else:
            cue, planted, label = _planted(r)
            places = [(0, len(planted))] * label
        cut = snippet.rfind(" ", 0, len(snippet) // 2) + 1
        head = snippet[:cut] + cue
        whole = f"{head}{planted} {snippet[cut:]}"
        # what the generators make of the planted span, boundaries included
        for start, kind, end in candidates(whole):
            if start < len(head) + len(planted) and end > len(head):
                a, b = start - len(head), end - len(head)
                plausible = any((a == s and b == e or kind == 0 and a <= s + 1 and b >= e) and _kind_fits(kind, planted[s:e])
                                for s, e in places)
                xs.append(features(whole, start, kind, end))
                ys.append(float(plausible))
                kinds.append(kind)
    x, y, kinds = np.array(xs), np.array(ys), np.array(kinds)
    part = r.integers(0, 3, len(y))
    trees = Trees(x[part == 0], y[part == 0])
    p = trees.probability(x)
    thresholds = []
    for kind in range(len(KINDS)):
        held = (kinds == kind) & (part == 1)
        order = np.argsort(-p[held], kind="stable")
        right, scores = y[held][order], p[held][order]
        share = np.cumsum(right) / np.arange(1, len(right) + 1)
        fine = np.flatnonzero((share >= precision) & np.r_[scores[1:] != scores[:-1], True]) if len(right) else []
        thresholds.append(max(0.5, float(scores[fine[-1]])) if len(fine) and right.sum() >= 20 else 2.0)
    test = (part == 2) & (p >= np.array(thresholds)[kinds])
    return Model(trees, tuple(thresholds), float(y[test].mean()) if test.any() else 1.0)


def _kind_fits(kind: int, planted: str) -> bool:
    if "at" in planted.lower():
        return kind == 0
    n = sum(map(str.isdigit, planted))
    dots = planted.count(".")
    return kind == (2 if n > 15 else 1 if dots == 3 else 3)


# --- the operator ---

SCORED = 20_000

def _best(scored: list[tuple[tuple[int, int, int], float]]) -> list[tuple[int, int, int]]:
    """The spans without overlap that have most log-odds, counted for every character."""
    scored = sorted(scored, key=lambda x: (x[0][2], x[0]))
    ends = [s[2] for s, _ in scored]
    total, before = [0.0], []
    for k, ((a, _, b), p) in enumerate(scored):
        before.append(bisect.bisect_right(ends, a, 0, k))
        p = min(p, 1 - 1e-9)
        total.append(max(total[k], total[before[k]] + (b - a) * (np.log(p / (1 - p)) + 1e-6)))
    out, k = [], len(scored)
    while k:
        if total[k] > total[k - 1]:
            out.append(scored[k - 1][0])
            k = before[k - 1]
        else:
            k -= 1
    return out[::-1]


def _selected(texts: list[str], model: tuple) -> list[tuple[list, list]]:
    """For every text the strict spans and the added ones."""
    base = [base_spans(t) for t in texts]
    rows, owner, scores, waiting = [], [], [], []
    trees, thresholds = model
    least = np.array(thresholds)

    def score():
        if waiting:
            p = _probability(trees, np.array([features(texts[i], *s) for i, s in waiting], float))
            for k in np.flatnonzero(p >= least[[s[1] for _, s in waiting]]).tolist():
                owner.append(waiting[k][0])
                rows.append(waiting[k][1])
                scores.append(p[k])
            waiting.clear()

    for i, t in enumerate(texts):
        spans = _candidates(t)
        marks = None
        while part := list(itertools.islice(spans, SCORED)):  # a text may be all numbers: what scores too low is not held
            if marks is None:
                marks = bytearray(len(t))  # 1 where a span lies
                for a, _, b in base[i]:
                    marks[a:b] = b"\1" * (b - a)
            waiting += [(i, s) for s in part if marks.find(1, s[0], s[2]) < 0]
            if len(waiting) >= SCORED:
                score()
    score()
    added: list[list] = [[] for _ in texts]
    by_text: dict[int, list] = {}
    for i, span, p in zip(owner, rows, scores):
        by_text.setdefault(i, []).append((span, p))
    for i, scored in by_text.items():
        added[i] = _best(scored)
    return list(zip(base, added))


def found(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` for every row of ``docs``.

    Counts and ``base_sha256`` are over the strict spans, ``spans`` lists all, as ``kind:start:end`` by start and kind,
    joined by commas; positions are code points, ends exclusive. A null text is an empty one and has no spans. Rows do
    not influence each other, so repeated rows and null keys come out as they went in; an empty table gives an empty
    table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    kind = docs.schema[key].dataType.simpleString()

    def listed(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def run(batches):
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            both = _selected(texts, shared.value)
            counts = [[sum(s[1] == k for s in base) for base, _ in both] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow_type(kind)), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in both], pa.string()),
                 pa.array([listed(base + added) for base, added in both], pa.string()),
                 pa.array([len(added) for _, added in both], pa.int64())],
                names=[key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {counts}, base_sha256 string, spans string, n_added bigint")


def redacted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, in the same columns; nulls stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    place = docs.columns.index(text)
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def without(t, spans):
        out, done = [], 0
        for a, k, b in sorted(spans):
            if a < done:  # strict spans of several kinds may overlap: the first one's tag stands for both
                done = max(done, b)
                continue
            out += [t[done:a], f"[{KINDS[k].upper()}]"]
            done = b
        return "".join(out) + t[done:]

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            both = _selected([t or "" for t in texts], shared.value)
            new = [t if t is None or not (base or added) else without(t, base + added) for t, (base, added) in zip(texts, both)]
            columns = batch.columns
            columns[place] = pa.array(new, batch.column(place).type)
            if length is not None:
                n = [old if a is b else len(b) for old, a, b in zip(batch.column(length).to_pylist(), texts, new)]
                columns[length] = pa.array(n, batch.column(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
