"""Near-duplicate documents by MinHash, exact confirmation and connected components.

1. Every text becomes its set of distinct word shingles, as 64-bit hashes, and a sketch: the minima of many universal
   hash functions, grouped into bands, and one bit of every minimum. Texts with equal sets form a class, stood for by its
   least document, so copies are never compared.
2. Representatives that agree in a band are candidates. In every bucket one hub, the member with most bucket mates, is
   compared with the others: a bucket gives one pair a member, not all pairs.
3. Pairs whose bits agree well enough are confirmed on full sets. Confirmed links are joined into components.
4. Links that hubs don't show: buckets that still hold several components compare the members outside the bucket's
   largest component with the members of other components, bits first, then full sets. A link between two components
   always has an end outside the largest, so none is lost, and members already joined are never paired.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateweave.llm.common import BLANKS, LOWER, UPPER, saved
from rateweave.llm.components import components
from rateweave.operators.ranking import global_row_number

WORD_BITS = 64


@dataclass(frozen=True)
class MinHash:
    """Parameters. Two sets are linked when ``scale`` times their intersection is at least ``least`` times their union.

    There are ``minima`` hash functions; the first ``bands * rows`` make the bands, all give a bit. A pair at the limit of
    0.85 shares no band with probability (1 - 0.85^6)^42 = 2e-9. ``most_unlike`` bits may differ before a pair is given
    up unseen: at 0.85 the mean is 77 and the deviation 8.4, so that happens with probability 1e-6.
    """

    words: int = 5
    minima: int = 1024
    bands: int = 42
    rows: int = 6
    most_unlike: int = 119
    least: int = 85
    scale: int = 100


DEFAULT = MinHash()


def _mixed(x):
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, length: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; empty without words."""
    import xxhash

    lower = bytes.maketrans(UPPER.encode(), LOWER.encode())
    words = text.encode().translate(lower).split()  # bytes.split knows just the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(length, len(words))
    odd = _mixed(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total += hashes[k:len(words) - size + 1 + k] * odd[k]
    return np.unique(_mixed(total))


def sketch(docs: DataFrame, how: MinHash = DEFAULT) -> DataFrame:
    """``(doc_id, n_shingles, k1, k2, bands, bits)``; ``k1, k2`` name the set."""
    n, banded, longs = how.minima, how.bands * how.rows, how.minima // WORD_BITS

    def run(batches):
        import xxhash

        seeds = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
        times, plus = seeds[:n] | np.uint64(1), seeds[n:]
        fold = _mixed(np.arange(how.rows, dtype=np.uint64) + np.uint64(1_000)) | np.uint64(1)
        places = np.arange(how.bands, dtype=np.uint64)
        for batch in batches:
            sizes, keys, bands, bits = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py() or "", how.words)
                sizes.append(len(found))
                if not len(found):
                    keys.append((0, 0))
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                keys.append((int(digest[0]), int(digest[1])))
                minima = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(found), 128):
                    part = np.multiply.outer(found[at:at + 128], times)
                    part += plus
                    np.minimum(minima, part.min(axis=0), out=minima)
                minima = _mixed(minima)
                rows = minima[:banded].reshape(how.bands, how.rows)
                bands.append(_mixed((rows * fold).sum(axis=1, dtype=np.uint64) + places).view(np.int64))
                bits.append(np.packbits((minima & np.uint64(1)).astype(np.uint8), bitorder="little"))
            full = np.array(sizes, np.int64) > 0

            def lists(parts, width):
                ends = np.r_[0, np.cumsum(full * width)].astype(np.int32)
                flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

            packed = [b.view(np.int64) for b in bits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()), lists(bands, how.bands), lists(packed, longs)],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "bits"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, "
                                "bits array<bigint>")


def shingles(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, shingles)``: full sets."""
    def run(batches):
        for batch in batches:
            found = [shingle_set(text.as_py() or "", words).view(np.int64) for text in batch.column(1)]
            ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                             names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _unlike(a: str, b: str, longs: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)), F.lit(0))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, n, t)``: the sizes of the pairs' intersections and the sums of their sets' sizes."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("n"), (F.size("sa") + F.size("sb")).alias("t"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", how: MinHash = DEFAULT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    ``component_id`` is the least id reachable over links, ``kept`` says that it is the row's own. A text without words
    (null, empty, blank) has an empty set, no links and its own id. Rows with one id are one document, so texts under
    the same id are reachable from each other; repeated rows get the same answer each. A row with a null id takes the
    id of its equals and is kept if there is none (``component_id`` is null then). Ties cannot occur: the least id
    decides. An empty table gives an empty table; other columns are ignored.
    """
    longs = how.minima // WORD_BITS
    linked = how.scale * F.col("n") >= how.least * (F.col("t") - F.col("n"))
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = saved(sketch(own, how), "sketches")
    filled = known.filter("n_shingles > 0")
    classes = saved(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    heads = saved(filled.join(reps, "doc_id", "left_semi").groupBy("doc_id", "k1", "k2").agg(
        F.first("bands").alias("bands"), F.first("bits").alias("bits")), "heads")

    # buckets with several members
    entries = heads.select("doc_id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = saved(entries.join(shared, "bucket"), "members")
    facts = saved(members.groupBy("doc_id").agg(F.sum("size").alias("mates")).join(
        heads.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.first("bits")).alias("bits")), "doc_id"), "facts")
    # texts are shuffled at every size: which ones are wanted grows with the corpus and is never broadcast
    sets = saved(shingles(own.join(facts.select("doc_id").hint("merge"), "doc_id", "left_semi"), how.words), "sets")

    # a hub for every bucket
    hubs = members.join(facts.select("doc_id", "mates"), "doc_id").groupBy("bucket").agg(
        F.max_by("doc_id", F.struct("mates", -F.col("doc_id"))).alias("hub"))
    stars = members.join(hubs, "bucket").filter("doc_id <> hub").select(
        F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    bits = facts.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a"))
    bits_b = facts.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b"))
    # an id with several texts has no bits; its pairs are always measured
    alike = F.coalesce(_unlike("bits_a", "bits_b", longs) <= how.most_unlike, F.lit(True))
    tried = stars.join(bits, "a").join(bits_b, "b").filter(alike).select("a", "b")
    measured = saved(_measured(tried, sets), "measured")
    links = measured.filter(linked).select("a", "b")
    first = components(links)

    # what the hubs did not join
    placed = saved(members.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"),
                                        F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    gap = F.first(1.0 - F.col("n") / (F.col("t") - F.col("n")))
    known_gap = measured.groupBy("a", "b").agg(F.when(F.count(F.lit(1)) == 1, gap).alias("gap"))
    rest = placed.join(mixed.join(hubs, "bucket"), "bucket").filter("doc_id <> hub").withColumns({
        "a": F.least("doc_id", "hub"), "b": F.greatest("doc_id", "hub")})
    rest = saved(rest.join(known_gap, ["a", "b"], "left").select("bucket", "doc_id", "component", "largest", "gap"), "rest")
    met = facts.select("doc_id", "bits").join(
        rest.groupBy("doc_id").agg(F.collect_set("bucket").alias("buckets")), "doc_id")  # at most one a band
    rest = rest.join(met, "doc_id")
    outside = rest.filter("component <> largest").select(
        "bucket", F.col("doc_id").alias("a"), F.col("component").alias("ca"), F.col("bits").alias("bits_a"),
        F.col("buckets").alias("buckets_a"), F.col("gap").alias("gap_a"))
    others = rest.select(
        F.col("bucket").alias("bucket_b"), F.col("doc_id").alias("b"), F.col("component").alias("cb"),
        F.col("bits").alias("bits_b"), F.col("buckets").alias("buckets_b"), F.col("gap").alias("gap_b"),
        (F.col("component") == F.col("largest")).alias("inside"))
    # Jaccard distance is a metric: two sets whose distances to the hub differ by more than the limit are no link
    far = F.coalesce(F.abs(F.col("gap_a") - F.col("gap_b")) > 1.0 - how.least / how.scale + 1e-9, F.lit(False))
    once = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")
    across = outside.join(others, (F.col("bucket") == F.col("bucket_b")) & (F.col("ca") != F.col("cb"))
                          & (F.col("inside") | (F.col("a") < F.col("b"))) & ~far & alike & once)
    late = _measured(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets)
    late = late.filter(linked).select("a", "b")

    # texts under one id are one document
    labelled = saved(known.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left"), "labelled")
    several = labelled.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_z")
                                                                      ).filter("a <> _z").drop("_z")
    same_id = labelled.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    found = components(links.union(late).union(same_id))
    labelled = labelled.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return labelled.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", how: MinHash = DEFAULT) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with their columns.

    Every distinct text with a null id counts as a document of its own after those with an id, in the order of texts: it
    goes if it is a near copy of one before it, else one of its rows stays (the least as JSON). Texts without words stay.
    """
    own, content = F.col(key).cast("bigint"), F.col(text).cast("string")
    nameless = docs.filter(own.isNull())
    if nameless.isEmpty():
        gone = near_duplicates(docs, key, text, how).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
        return docs.join(gone, own == F.col("_gone"), "left_anti")
    blank = F.btrim(F.coalesce(content, F.lit("")), F.lit(BLANKS)) == ""
    row = F.struct(*docs.columns)
    texts = nameless.filter(~blank).groupBy(content.alias("_text")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    # numbers in the order of the ids, then of the texts: no number meets an id
    ids = saved(global_row_number(docs.filter(own.isNotNull()).select(own.alias("_id")).distinct(), ["_id"], "_n"), "ids")
    texts = saved(global_row_number(texts, ["_text"], "_n", ids.count() + 1), "nameless")
    numbered = docs.select(own.alias("_id"), content.alias("_text")).join(ids, "_id").select("_n", "_text")
    found = near_duplicates(numbered.union(texts.select("_n", "_text")), "_n", "_text", how).filter("not kept")
    gone = saved(found.select(F.col("doc_id").alias("_n")).distinct(), "gone")
    named = docs.filter(own.isNotNull()).join(
        ids.join(gone, "_n").select(F.col("_id").alias("_gone")), own == F.col("_gone"), "left_anti")
    return named.unionByName(nameless.filter(blank)).unionByName(texts.join(gone, "_n", "left_anti").select("_row.*"))
