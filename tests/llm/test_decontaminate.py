"""Decontamination against a word-by-word search."""

import hashlib
import random
import re

import pytest

from rateweave.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def by_hand(rows, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for at in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[at:at + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, seen = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[at:at + n]))):
                    hit.update(range(at, at + n))
                    seen |= owners
        listed = ",".join(sorted(map(str, seen)))
        out.append((i, len(w), len(hit), len(seen), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


R = random.Random(8)
VOCABULARY = [f"w{i}" for i in range(400)]
ITEMS = [(i, " ".join(R.choices(VOCABULARY, k=R.choice([12, 30, 7, 3])))) for i in range(20)]
ITEMS += [(30, ITEMS[0][1]), (31, None), (32, "..."), (33, "Straße ÉTÉ x"), (None, "nobody owns these words at all ever")]
ROWS = [(1, None), (2, ""), (3, "--"), (4, "STRASSE été x"), (5, "straße ÉTÉ, X"), (None, ITEMS[1][1]), (6, ITEMS[0][1].upper()),
        (6, ITEMS[0][1].upper()), (6, "other"), (7, " ".join([ITEMS[0][1]] * 3)), (8, "x " * 5000 + ITEMS[2][1] + " y" * 5000)]
ROWS += [(100 + i, " ".join(R.choices(VOCABULARY, k=40)) + (". " + R.choice(ITEMS[:20])[1] + "!\n" if i % 3 else "") + "tail end")
         for i in range(60)]


@pytest.mark.parametrize("most_broadcast", [10**6, 0])
def test_same_as_by_hand(spark, documents, most_broadcast):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(documents(ROWS, extra=True), items, most_broadcast=most_broadcast)
    want = by_hand(ROWS, [x for x in ITEMS if x[0] is not None])
    named = [x for x in sorted(map(tuple, got.collect()), key=repr)]
    assert named == want


def test_empty_tables(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents([]), items).count() == 0
    assert [r.contaminated for r in decontaminate.contamination(documents([(1, "a b")]), none).collect()] == [False]


def test_passages_go_and_clean_text_stays(spark, documents):
    passage = " ".join(VOCABULARY[:12])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = "A clean text,\nwith  odd   spacing. "
    long = " ".join(f"z{i}" for i in range(60))
    docs = documents([(1, clean), (2, passage), (3, f"{long}; {passage}. {long}\n"), (4, None)], extra=True)
    got = {r.doc_id: r.text for r in decontaminate.cleaned(docs, items).collect()}
    assert got == {1: clean, 3: f"{long}. {long}\n", 4: None}


def test_pieces_without_places(spark):
    from pyspark.sql import functions as F

    rows = [(list("abcdef"), p) for p in ([], [0], [5], [0, 1, 2, 3, 4, 5], [1, 3, 4])] + [([], [])]
    df = spark.createDataFrame(rows, "pieces array<string>, places array<int>")
    got = [r[0] for r in df.select(decontaminate.without_places(F.col("pieces"), F.col("places"))).collect()]
    assert got == ["".join(x for i, x in enumerate(pieces) if i not in places) for pieces, places in rows]


def test_a_very_long_text_with_many_passages(spark, documents):
    items = spark.createDataFrame([(1, " ".join(VOCABULARY[:12])), (2, "short one")], "item_id long, text string")
    words = []
    for i in range(2_000):
        words += [f"z{i}"] * 40 + (VOCABULARY[:12] if i % 4 == 0 else ["short", "one"] if i % 4 == 1 else [])
    docs = documents([(1, " ".join(words)), (2, " ".join(VOCABULARY[:11]))])
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[2].n_hit) == (500 * 12 + 500 * 2, 2, 11)
    left = {r.doc_id: r.text for r in decontaminate.cleaned(docs, items).collect()}
    assert left == {1: " ".join(w for w in words if w.startswith("z"))}
