"""Near duplicates against all pairs of small tables."""

import random

from rateweave.llm import components, neardup


def words_of(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [w for w in text.translate(table).split(" ") if w]


def shingles_of(text):
    w = words_of(text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_hand(rows):
    """``{id: component}`` by trying every pair of ids."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles_of(t))
    label = {i: i for i in sets}

    def linked(a, b):
        return any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])

    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and linked(a, b):
                    label[a], changed = label[b], True
    return label


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def family_rows():
    r = random.Random(3)
    rows, at = [], 0
    for size, most in ((40, 4), (30, 8), (5, 1), (3, 0)):
        base = [f"v{r.randrange(3000)}" for _ in range(120)]
        for _ in range(size):
            at += 1
            rows.append((at * 7 % 997, edited(r, base, r.randint(0, most))))
    rows += [(2000 + i, edited(r, ["x"] * 60, 60)) for i in range(40)]
    return rows


def found(docs):
    return {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs).collect()}


def test_families_as_by_hand(documents):
    rows = family_rows()
    label = by_hand(rows)
    assert len(set(label.values())) < len(label)
    assert found(documents(rows)) == {(i, len(shingles_of(t)), label[i], label[i] == i) for i, t in rows}


def test_odd_rows(documents):
    rows = [(9, "a b c"), (4, "A\tB\nc"), (5, "a b d"), (6, None), (7, ""), (8, " \n"), (4, "A\tB\nc"), (None, "a b c"),
            (None, "only here"), (10, "É x"), (11, "é x"), (12, "one two three")]
    assert found(documents(rows, extra=True)) == {
        (9, 1, 4, False), (4, 1, 4, True), (5, 1, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True),
        (None, 1, 4, False), (None, 1, None, True), (10, 1, 10, True), (11, 1, 11, True), (12, 1, 12, True)}
    assert neardup.near_duplicates(documents([])).count() == 0


def test_one_id_with_several_texts_is_one_document(documents):
    rows = [(1, "a b c d e f"), (2, "g h i j k"), (3, "a b c d e f"), (3, "g h i j k"), (4, "zz")]
    assert {(i, c) for i, _, c, _ in found(documents(rows))} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_links_of_every_text_of_an_id(documents):
    r = random.Random(9)
    one, two = [[f"u{r.randrange(10**6)}" for _ in range(100)] for _ in range(2)]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, edited(r, one, 1)), (3, edited(r, two, 1)), (4, "else")]
    assert {(i, c) for i, _, c, _ in found(documents(rows))} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_one_of_a_group_stays(documents):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y"), (None, "x y"), (None, "q"), (5, None)]
    kept = neardup.deduplicated(documents(rows, extra=True))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect())[-3:] == [(1, "a b c d e f"), (3, "x y"), (5, "")]
    assert kept.columns == documents(rows, extra=True).columns


def test_long_text(documents):
    r = random.Random(1)
    base = [f"v{r.randrange(10**5)}" for _ in range(60_000)]
    rows = [(1, " ".join(base)), (2, edited(r, base, 300)), (3, edited(r, base, 6_000))]
    assert {(i, c) for i, _, c, _ in found(documents(rows))} == {(1, 1), (2, 1), (3, 3)}


def test_components_of_paths_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (3, 3)] + [(7, x) for x in range(500, 560)]
    edges += [(None, 4), (2, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 3: 1, 7: 7} | {x: 7 for x in range(500, 560)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_id_are_deduplicated(documents):
    r = random.Random(6)
    base = [f"v{r.randrange(10**6)}" for _ in range(100)]
    near, other = edited(r, base, 1), [f"o{r.randrange(10**6)}" for _ in range(100)]
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y"), (None, "x y"), (None, "q"), (None, "q"), (5, None), (None, None),
            (None, ""), (2**63 - 1, " ".join(base)), (None, near), (None, " ".join(other)), (None, " ".join(other)),
            (None, edited(r, other, 1)), (7, "z"), (7, "z")]
    got = sorted(((x.doc_id, x.text) for x in neardup.deduplicated(documents(rows, extra=True)).collect()), key=repr)
    assert sum(t is not None and t.startswith("o") or t is not None and " o" in t for _, t in got) == 1
    left = [(1, "a b c d e f"), (3, "x y"), (None, "q"), (5, None), (None, None), (None, ""), (2**63 - 1, " ".join(base)), (7, "z"), (7, "z")]
    assert [x for x in got if not (x[1] and " o" in x[1])] == sorted(left, key=repr)
