"""The Merkle manifest against a plain version that holds all rows in one list."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rateweave.llm import manifest
from rateweave.llm.common import ascii_lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(digests, fan=16):
    """The root, and for every digest its path: one (siblings before, siblings after) a level."""
    paths, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, p in enumerate(places):
            first = p // fan * fan
            paths[i].append((digests[first:p], digests[p + 1:first + fan]))
        digests = [h(*digests[i:i + fan]) for i in range(0, len(digests), fan)]
        places = [p // fan for p in places]
    return digests[0], paths


def plain(rows, fan=16):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row, leaf(*row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = []
    for name in names:
        leaves = sorted(groups[name], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        found.append((leaves, *tree([d for _, d in leaves], fan)))
    root, above = tree([s for _, s, _ in found], fan)
    out = []
    for (leaves, subroot, paths), top in zip(found, above):
        for (row, digest), path in zip(leaves, paths):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            f = leaf(row[0], lowered(row[1]), *row[2:]) if tampered else digest
            for before, after in path + top:
                f = h(*before, f, *after)
            proof = h(*[d for before, after in path + top for d in before + after])
            out.append((row[0], digest, subroot, root, proof, f, f == root))
    return sorted(out, key=repr)


def audited(docs, **how):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest.audited(docs, F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text")), **how)


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=repr)


def test_trees_of_many_sizes(spark):
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "e": 256, "f": 257, "hot": 4200, "é": 3, "": 5, None: 18}
    given, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            given.append((n * 7919 % 100_003, f"Text {n} É", "en", source, n))
    got = rows(audited(spark.createDataFrame(given, SCHEMA).repartition(7)))
    assert got == plain(given)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("fan", [2, 3])
def test_other_widths(spark, fan):
    given = [(i, f"T{i}", "en", f"s{i % 40}", i) for i in range(333)]
    assert rows(audited(spark.createDataFrame(given, SCHEMA), fan=fan)) == plain(given, fan)


def test_nulls_ties_repeats_and_long_texts(spark):
    given = [(None, None, None, None, None)] * 20 + [(5, "A" * 300_000, "en", "s", 1)] * 3 + [
        (5, "other", "en", "s", 1), (5, "", "", "s", None), (None, "Ab", None, "s", 2), (20, "ABC", None, None, 3)]
    assert rows(audited(spark.createDataFrame(given, SCHEMA))) == plain(given)


def test_one_row_and_no_row(spark):
    given = [(3, "x", "en", "s", 1)]
    got = rows(audited(spark.createDataFrame(given, SCHEMA)))
    assert got == plain(given) and got[0][1] == got[0][2] == got[0][3]
    assert rows(audited(spark.createDataFrame([], SCHEMA))) == []


def test_columns_with_clashing_names_are_ignored(spark):
    given = [(i, f"T{i}", "en", f"s{i % 3}", i) for i in range(60)]
    docs = spark.createDataFrame(given, SCHEMA)
    for name in ("tree", "place", "n", "node", "path", "leaf", "digest", "again", "row", "id", "name", "children", "root"):
        docs = docs.withColumn(name, F.lit(1))
    assert rows(audited(docs)) == plain(given)


def test_the_same_at_every_layout(spark):
    given = [(i % 50, f"T{i % 9}", "en", f"s{i % 2}", 1) for i in range(400)]
    docs = spark.createDataFrame(given, SCHEMA)
    assert rows(audited(docs.coalesce(1))) == rows(audited(docs.repartition(11))) == plain(given)


def test_a_changed_row_is_found_and_a_wrong_width_refused(spark):
    given = [(i, f"t{i}", "en", "s", i) for i in range(100)]
    docs = spark.createDataFrame(given, SCHEMA)
    changed = F.when(F.col("doc_id") == 42, "forged").otherwise(F.col("text"))
    found = manifest.audited(docs, changed).filter("not verified").select("doc_id").collect()
    assert [r.doc_id for r in found] == [42]
    with pytest.raises(ValueError):
        manifest.audited(docs, F.col("text"), fan=1)
