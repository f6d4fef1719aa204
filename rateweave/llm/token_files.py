"""Token-id files compressed with Re-Pair grammars.

Documents are put in order of their ids, encoded, ended with an end id and packed into shards. In a shard the most
frequent pairs of neighbouring ids are replaced by nonterminals, again and again, until no pair is there ``LEAST_COUNT``
times or a round saves less than ``LEAST_SAVED`` of the sequence; in a run of one id every other place is a pair. A shard is
a row of a Parquet table:

    part, shard      place in the order: range partition, shard within it
    first, n_ids     ids before the shard within its part; ids in it
    doc_ids, ends    the documents in it; ids up to each one's end
    base             nonterminal k stands for symbol base + k
    rules            left and right symbol of every nonterminal, 32-bit little-endian
    sizes            how many ids every nonterminal expands to, 32-bit
    width, symbols   the sequence, ``width`` bytes each
    marks            ids before every ``MARK``-th symbol, 64-bit: where to start for random access

Spark's writer commits a task's file as a whole, so lost executors leave no broken shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rateweave.llm.bpe import _parts, read_vocabulary
from rateweave.llm.common import scratch
from rateweave.llm.pretokens import library_ids

#: A shard closes once it has so many ids; a longer document has a shard of its own.
SHARD_IDS = 1_000_000
MARK = 1_024
#: Pairs that are replaced in one round, the least count of such a pair, and the share a round has to save.
PAIRS, LEAST_COUNT, LEAST_SAVED = 512, 24, 0.01


# --- grammar ---

def _round(seq: np.ndarray, turn: int, base: int, known: int) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """One round: the new sequence, the new rules and the number of replacements.

    Pairs are counted by hash in a table. Every slot speaks for one pair, the last that fell into it, and counts only
    that; pairs that lost their slot have another chance with the next round's hash.
    """
    left, right = seq[:-1], seq[1:]
    odd = np.uint32(2654435761 + 2 * 7919 * turn & 0xFFFFFFFF)
    slot = ((left * odd + right) * np.uint32(2246822519) >> np.uint32(12)).astype(np.int32)
    place = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= LEAST_COUNT)[slot]).astype(np.int32)
    slot = slot[place]
    speaker = np.zeros(1 << 20, np.int32)
    speaker[slot] = place
    spoken = speaker[slot]
    own = (left[spoken] == left[place]) & (right[spoken] == right[place])
    place, slot = place[own], slot[own]
    count = np.bincount(slot, minlength=1 << 20)
    often = np.flatnonzero(count >= LEAST_COUNT)
    a, b = left[speaker[often]].astype(np.int64), right[speaker[often]].astype(np.int64)
    # no symbol may end one chosen pair and begin another, so occurrences of different pairs never overlap
    rule_of, rules, lefts, rights = np.full(1 << 20, -1, np.int32), [], set(), set()
    saved = np.where(a == b, count[often] // 2, count[often])  # in a run every other place can be replaced
    for k in np.lexsort((b, a, -saved)).tolist():
        x, y = int(a[k]), int(b[k])
        if saved[k] >= LEAST_COUNT and x not in rights and y not in lefts and (x != y or x not in lefts and x not in rights):
            lefts.add(x)
            rights.add(y)
            rule_of[often[k]] = len(rules)
            rules.append((x, y))
            if len(rules) == PAIRS:
                break
    rule = rule_of[slot]
    spots, rule = place[rule >= 0], rule[rule >= 0]
    # places of a pair of one symbol with itself are neighbours within a run: take the first, the third, ...
    begins = np.flatnonzero(np.diff(spots, prepend=-2) != 1)
    within = np.arange(len(spots)) - np.repeat(begins, np.diff(begins, append=len(spots)))
    spots, rule = spots[within % 2 == 0], rule[within % 2 == 0]
    seq = seq.copy()
    seq[spots] = (base + known + rule).astype(np.uint32)
    keep = np.ones(len(seq), bool)
    keep[spots + 1] = False
    return seq[keep], rules, len(spots)


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols, rules, sizes)``; rule ``k`` is the pair that symbol ``base + k`` stands for.

    A round replaces up to ``PAIRS`` pairs at once, by falling count; rounds end when one saves too little.
    """
    seq, rules, turn = ids.astype(np.uint32), [], 0
    while len(seq) > 1:
        before = len(seq)
        seq, new, saved = _round(seq, turn, base, len(rules))
        rules += new
        turn += 1
        if saved < LEAST_SAVED * before:
            break
    sizes: list[int] = []
    for a, b in rules:
        sizes.append(sum(1 if x < base else sizes[x - base] for x in (a, b)))
    return seq.astype(np.int64), np.array(rules, np.int64).reshape(-1, 2), np.array(sizes, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    # what every nonterminal expands to, one after the other; rules refer to earlier ones only
    starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    flat = np.empty(int(starts[-1]), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        at = int(starts[k])
        for x in (a, b):
            if x < base:
                flat[at] = x
                at += 1
            else:
                n = int(sizes[x - base])
                flat[at:at + n] = flat[starts[x - base]:starts[x - base] + n]
                at += n
    length = np.ones(len(symbols), np.int64)
    inner = symbols >= base
    length[inner] = sizes[symbols[inner] - base]
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    out[(ends - length)[~inner]] = symbols[~inner]
    first, n = (ends - length)[inner], length[inner]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(first, n) + within] = flat[np.repeat(starts[symbols[inner] - base], n) + within]
    return out


class Shard:
    """A shard's columns, decoded as far as asked."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")
        self.marks = np.frombuffer(row["marks"], "<i8")
        self.doc_ids, self.ends = row["doc_ids"], row["ends"]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi``, expanding only the symbols around them."""
        if lo >= hi:
            return np.empty(0, np.int64)
        mark = int(np.searchsorted(self.marks, lo, side="right")) - 1
        last = int(np.searchsorted(self.marks, hi, side="left"))
        part = self.symbols[mark * MARK:last * MARK].astype(np.int64)
        skipped = lo - int(self.marks[mark])
        return expand(part, self.rules, self.sizes, self.base)[skipped:skipped + hi - lo]

    def documents(self):
        """``(doc_id, first id, ids)`` of all documents."""
        every, lo = self.ids(0, int(self.ends[-1]) if self.ends else 0), 0
        for doc_id, hi in zip(self.doc_ids, self.ends):
            yield doc_id, lo, every[lo:hi]
            lo = hi


def _packed(doc_ids: list, encodings: list[np.ndarray], base: int) -> dict:
    ids = np.concatenate(encodings)
    symbols, rules, sizes = compress(ids, base)
    length = np.ones(len(symbols), np.int64)
    length[symbols >= base] = sizes[symbols[symbols >= base] - base]
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {"n_ids": len(ids), "doc_ids": doc_ids, "ends": np.cumsum([len(e) for e in encodings]).tolist(), "base": base,
            "rules": rules.astype("<u4").tobytes(), "sizes": sizes.astype("<u4").tobytes(), "width": width,
            "symbols": symbols.astype(f"<u{width}").tobytes(),
            "marks": (np.cumsum(length) - length)[::MARK].astype("<i8").tobytes()}


SHARD_SCHEMA = ("part int, shard int, first bigint, n_ids bigint, doc_ids array<bigint>, ends array<bigint>, base int, "
                "rules binary, sizes binary, width int, symbols binary, marks binary")
_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("base", pa.int32()),
                    ("rules", pa.binary()), ("sizes", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary()),
                    ("marks", pa.binary())])


# --- writing and reading ---

def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2,
          shard_ids: int = SHARD_IDS, partition_bytes: int = 32_000_000) -> None:
    """Encode ``docs`` by the tokenizer file at ``path`` and write shards to ``folder``, in ascending order of ``key``.

    A null text is an empty one and has just the end id. Null keys come first; rows with one key are ordered by their
    texts' hashes, then by the texts, so repeated rows each have their place. An empty table writes a table without rows. Other columns are ignored.
    Range partitions grow in number with the texts' bytes.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = docs.select(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    slots = spark.sparkContext.defaultParallelism
    parts = max(slots, -(-total // partition_bytes))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions(
        "doc_id", "h", "text").drop("h")

    def run(batches):
        from pyspark import TaskContext

        library = library_ids(vocabulary.value)
        base = library.library.get_vocab_size()
        end = np.array([end_id], np.int32)
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, held, n = [], [], 0

        def closed():
            row = _packed(doc_ids, held, base) | {"part": part, "shard": shard, "first": first}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for some in _parts(batches):
            for (doc_id, _), ids in zip(some, library.encode([t for _, t in some])):
                ids = np.append(np.frombuffer(ids, np.int32), end)
                if n and n + len(ids) > shard_ids:
                    yield closed()
                    shard, first, doc_ids, held, n = shard + 1, first + n, [], [], 0
                doc_ids.append(doc_id)
                held.append(ids)
                n += len(ids)
        if n:
            yield closed()

    ordered.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(folder)


def part_starts(shards: DataFrame) -> DataFrame:
    """``(part, offset)``: the ids of all range partitions before one; a row for each partition."""
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def summaries(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` per document, from the files; the checksum is over 32-bit little-endian ids."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = [(row["part"], d, row["first"] + lo, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                         for d, lo, ids in Shard(row).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)],
                                                 names=["part", "doc", "first", "n_tokens", "ids_crc32"])

    shards = read(spark, folder)
    found = shards.mapInArrow(run, "part bigint, doc bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    # shards are decoded where they are read; what meets the offsets is a short row for each document
    return found.join(part_starts(shards), "part").select(
        F.col("doc").alias(key), (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` of the documents in ``wanted``, by random access: only their symbols are expanded."""
    shards = read(spark, folder)
    places = shards.select("part", "shard", F.posexplode("doc_ids").alias("_at", key))
    asked = places.join(wanted.select(key).distinct(), key).groupBy("part", "shard").agg(F.sort_array(F.collect_list("_at")).alias("_asked"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard, ends = Shard(row), [0, *row["ends"]]
                found = [(row["doc_ids"][at], shard.ids(ends[at], ends[at + 1])) for at in row["_asked"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in found], pa.int64()), pa.array([x.tolist() for _, x in found], pa.list_(pa.int32()))],
                    names=[key, "ids"])

    return shards.join(asked, ["part", "shard"]).mapInArrow(run, f"`{key}` bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, **how) -> DataFrame:
    """Write ``docs`` to a new shared folder and summarise what the files hold."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    write(docs, folder, path, key, text, end_id, **how)
    return summaries(spark, folder, key)
