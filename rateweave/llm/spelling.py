"""Spelling variants by a relational trie frontier.

The vocabulary's trie is a distributed edge table. A word walks through it as rows ``(word, position, node, edits)``: states
are joined with the edges level by level, a step without an edit needs an edge with the word's own next characters, and one
edit may delete a character of the word or replace it by another edge's. States that end on a terminal with one edit name
two words that are one edit apart.

What keeps the frontier small at the size of a corpus's vocabulary:

- Of two words that are one edit apart, the edit lies in the second half of a word read forwards or read backwards. So there
  are two tries, of words and of reversed words, and edits start in a word's second half only, where the trie is thin. The
  state before the edit needs no join: it is on the word's own path.
- An insertion is a deletion seen from the other word, and a replacement is found by the smaller of two characters; links
  are made symmetric in the end.
- Each edge knows which characters may follow its end (a 64-bit mask, exact or too wide), so most edits end where they start.
- After the edit the rest has to match, so the trie has edges of 1, 2, 4, ... characters, at depths that their length
  divides, and a state takes the longest one that fits: the number of levels is logarithmic in the longest word, and a word
  takes rows in proportion to its length, however long it is.

Nodes and labels are 64-bit hashes of what they stand for; words that meet at a terminal are compared as text, so a
collision adds nothing to the result, and none can be lost by one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.llm.common import saved

#: What a run is, which documents lose a character, which words count.
RUN = "[A-Za-zÀ-ÿ]"
EVERY, LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 97, 5, 3, 2

#: Different words that a task counts before it sends them on.
HELD = 400_000
#: Words that one step of the numpy kernels takes, by characters.
CHARACTERS = 400_000
#: The bit that stands for the end of a word; the others stand for characters.
END_BIT = 63


# --- the vocabulary ---

def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, length: int = LEAST_LENGTH,
                least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of all runs with at least ``length`` characters and ``least`` occurrences in the whole table.

    A-Z are lower-cased; where ``every`` divides the crc32 of ``<key>:<run>``, the run loses the character that the crc32
    points to. A null key is written as nothing, a null text has no runs. Counts are added up in each task first.
    """
    data_type = docs.schema[key].dataType.simpleString()
    if data_type not in ("bigint", "int", "smallint", "tinyint", "string"):
        raise ValueError(f"a key of type {data_type} has no plain text form")
    find = re.compile(f"{RUN}{{{length},}}").findall
    capitals = {c: c + 32 for c in range(65, 91)}

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             names=["word", "n"])
            counts.clear()
            return out

        crc32, get = zlib.crc32, counts.get
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if not t:
                    continue
                prefix = crc32(b":" if k is None else f"{k}:".encode())
                for raw, n in Counter(find(t)).items():
                    word = raw.lower() if raw.isascii() else raw.translate(capitals)
                    h = crc32(word.encode(), prefix)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < length:
                            continue
                    counts[word] = get(word, 0) + n
                if len(counts) > HELD:
                    yield flush()
        if counts:
            yield flush()

    found = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- hashes of all parts of many words at once ---

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Parts:
    """Hashes of the prefixes and parts of a block of words, read in one direction (0 or 1)."""

    def __init__(self, words: list[str], direction: int):
        self.lengths = np.array([len(w) for w in words], np.int64)
        joined = "".join(w[::-1] if direction else w for w in words)
        self.codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.salt = np.uint64((direction + 1) * 0xD1342543DE82EF95 & _MASK)
        most = int(self.lengths.max()) + 1
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(most, _BASE, np.uint64)])
        inverse = pow(_BASE, -1, 1 << 64)
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(most, inverse, np.uint64)])
        inside = np.arange(len(self.codes)) - np.repeat(self.starts, self.lengths)
        self.sums = np.r_[np.uint64(0), np.cumsum((self.codes + 1).astype(np.uint64) * self.power[inside])]

    def node(self, word, depth):
        """The node of each word's first ``depth`` characters."""
        value = self.sums[self.starts[word] + depth] - self.sums[self.starts[word]]
        return _mixed(_mixed(value + self.salt) + depth.astype(np.uint64)).view(np.int64)

    def label(self, word, at, size):
        """The label of each word's ``size`` characters from ``at`` on."""
        start = self.starts[word] + at
        value = (self.sums[start + size] - self.sums[start]) * self.inverse[at]
        return _mixed(_mixed(value) + size.astype(np.uint64)).view(np.int64)

    def code(self, word, at):
        return self.codes[self.starts[word] + at]


def _spread(first, last):
    """``(owner, value)`` of the ranges ``first[i] .. last[i] - 1``, one after the other."""
    sizes = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(first)), sizes)
    return owner, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def _blocks(batches):
    """The words of the batches in blocks of bounded size."""
    for batch in batches:
        words, held = [], 0
        for w in batch.column(0).to_pylist():
            words.append(w)
            held += len(w)
            if held >= CHARACTERS:
                yield words
                words, held = [], 0
        if words:
            yield words


def _edges(batches):
    """Edges from the second half of every word on: ``(node, code, label, child)``; ``code`` for single characters."""
    for words in _blocks(batches):
        for direction in (0, 1):
            parts = Parts(words, direction)
            size = 1
            while size <= parts.lengths.max():
                word, step = _spread(-(-(parts.lengths // 2) // size), (parts.lengths // size))
                at = step * size
                # keep the block's different edges only
                node = parts.node(word, at)
                child, keep = np.unique(parts.node(word, at + size), return_index=True)
                sizes = np.full(len(word), size)
                label = parts.label(word, at, sizes)[keep]
                code = pa.array(parts.code(word, at)[keep]) if size == 1 else pa.nulls(len(keep), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), code, pa.array(label), pa.array(child)],
                                                 names=["node", "code", "label", "child"])
                size *= 2


def _terminals(batches):
    """``(word, n, id, back)``: where each word ends in either trie; ``id``, its node in the first, stands for the word."""
    for batch in batches:
        at = 0
        for words in _blocks([batch]):
            every = np.arange(len(words))
            ends = [parts.node(every, parts.lengths) for parts in (Parts(words, 0), Parts(words, 1))]
            part = batch.slice(at, len(words))
            at += len(words)
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, ends)], names=["word", "n", "id", "back"])


def _labels(parts, word, depth, at):
    """Labels of the edges that lead from ``depth`` to the word's end, its characters being read from ``at`` on."""
    rest = parts.lengths[word] - at
    owners, labels = [], []
    active, depth, at = np.arange(len(word)), depth.copy(), at.copy()
    while True:
        active = active[rest[active] > 0]
        if not len(active):
            break
        d, r = depth[active], rest[active]
        size = np.minimum(d & -d, 1 << np.floor(np.log2(r)).astype(np.int64))
        owners.append(active)
        labels.append(parts.label(word[active], at[active], size))
        depth[active] += size
        at[active] += size
        rest[active] -= size
    if not owners:
        return pa.ListArray.from_arrays(np.zeros(len(word) + 1, np.int32), pa.array([], pa.int64()))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(word)))].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(labels)[order]))


def _seeds(batches):
    """The states just before their edit: ``(id, node, code, bit, replaced, deleted)``.

    ``code`` is the character at the edit, ``bit`` stands for the one after it; ``replaced`` and ``deleted`` are the labels
    that have to follow a replacement and a deletion (null where the same deletion is offered one character before).
    """
    for words in _blocks(batches):
        every = np.arange(len(words))
        forward = Parts(words, 0)
        ids = forward.node(every, forward.lengths)
        for direction in (0, 1):
            parts = forward if direction == 0 else Parts(words, 1)
            word, at = _spread(parts.lengths // 2, parts.lengths)
            code = parts.code(word, at)
            last = at + 1 == parts.lengths[word]
            after = parts.code(word, np.minimum(at + 1, parts.lengths[word] - 1))
            bit = np.where(last, END_BIT, after % END_BIT)
            again = (at > parts.lengths[word] // 2) & (code == parts.code(word, np.maximum(at - 1, 0)))
            deleted = _labels(parts, word, at, at + 1)
            deleted = pa.ListArray.from_arrays(deleted.offsets, deleted.values, mask=pa.array(again))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[word]), pa.array(parts.node(word, at)), pa.array(code), pa.array(bit),
                 _labels(parts, word, at + 1, at + 1), deleted], names=["id", "node", "code", "bit", "replaced", "deleted"])


# --- the frontier ---

def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` candidates of words one edit apart, in one direction or both, from ``vocabulary(word, id, back)``."""
    words = vocabulary.select("word")
    edges = saved(words.mapInArrow(_edges, "node bigint, code bigint, label bigint, child bigint")
                       .groupBy("node", "label", "child").agg(F.max("code").alias("code")), "edges")
    ends = vocabulary.select(F.col("id").alias("node"), F.col("id").alias("end")).unionAll(
        vocabulary.select(F.col("back").alias("node"), F.col("id").alias("end")))
    single = edges.filter("code is not null")
    # what may follow each node
    bits = single.select("node", F.expr(f"shiftleft(1L, cast(code % {END_BIT} as int))").alias("b")).unionAll(
        ends.select("node", F.expr(f"shiftleft(1L, {END_BIT})").alias("b")))
    follow = saved(bits.groupBy("node").agg(F.bit_or("b").alias("follow")), "follow")
    children = single.join(follow.withColumnsRenamed({"node": "child", "follow": "next"}), "child")
    # an alphabet's size at most under one node
    children = children.groupBy("node").agg(F.collect_list(F.struct("code", "child", "next")).alias("children"))
    nodes = follow.join(children, "node", "left")

    seeds = words.mapInArrow(_seeds, "id bigint, node bigint, code bigint, bit bigint, replaced array<bigint>, deleted array<bigint>")
    met = seeds.join(nodes, "node").withColumn("mask", F.expr("shiftleft(1L, cast(bit as int))"))
    fits = F.filter("children", lambda c: (c["code"] > F.col("code")) & (c["next"].bitwiseAND(F.col("mask")) != 0))
    kept = F.when(F.col("deleted").isNotNull() & (F.col("follow").bitwiseAND(F.col("mask")) != 0),
                  F.array(F.struct(F.col("node").alias("node"), F.col("deleted").alias("labels"))))
    moved = F.transform(fits, lambda c: F.struct(c["child"].alias("node"), F.col("replaced").alias("labels")))
    none = "array<struct<node:bigint,labels:array<bigint>>>"
    edited = F.concat(F.coalesce(kept.cast(none), F.array().cast(none)), F.coalesce(moved.cast(none), F.array().cast(none)))
    states = met.select("id", F.explode(edited).alias("s")).select("id", "s.node", "s.labels")
    states = saved(states, "states")

    done, level = states.filter("size(labels) = 0").select("id", "node"), 0
    steps = edges.select("node", "label", "child")
    while True:
        going = states.filter(F.size("labels") > level).withColumn("label", F.get("labels", F.lit(level)))
        if going.isEmpty():
            break
        level += 1
        states = saved(going.join(steps, ["node", "label"]).select("id", F.col("child").alias("node"), "labels"), "states")
        done = done.unionAll(states.filter(F.size("labels") == level).select("id", "node"))
    return done.join(ends, "node").select(F.col("id").alias("id_a"), F.col("end").alias("id_b")).distinct()


def variants(counts: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``counts(word, n)``, whose words differ.

    Two words are near if one insertion, deletion or replacement of a character makes one of the other. A word's ``form``
    is its near word with the largest count, the first in code-point order among equals, if that count is at least
    ``dominance`` times the word's own; ``root`` is where the forms lead, the word itself without a form. Words of at least
    two characters of any length take part; an empty table gives an empty table. No word's neighbours are gathered: they
    are counted and compared by aggregates that start before the shuffle.
    """
    if dominance < 2:
        raise ValueError("forms must grow, or they lead in circles")
    vocabulary = saved(counts.select("word", F.col("n").cast("bigint")).mapInArrow(
        _terminals, "word string, n bigint, id bigint, back bigint"), "vocabulary")
    found = near_words(vocabulary)
    a = vocabulary.select(F.col("id").alias("id_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = vocabulary.select(F.col("id").alias("id_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    one = found.join(a, "id_a").join(b, "id_b").filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
    both = one.unionAll(one.select("b", "n_b", "a", "n_a")).distinct()
    near = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "b")).alias("best"))
    joined = vocabulary.join(near.withColumnRenamed("a", "word"), "word", "left")
    dominant = -F.col("best.m") >= dominance * F.col("n")
    forms = saved(joined.select("word", F.when(dominant, F.col("best.b")).alias("form"), "n",
                                F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                F.when(dominant, -F.col("best.m")).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words with a form. Each round doubles the way that ``root`` has gone; ways are logarithmic in
    the largest count, because a form occurs at least twice as often."""
    roots = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, length: int = LEAST_LENGTH,
                      least: int = LEAST_COUNT, dominance: int = DOMINANCE) -> DataFrame:
    """``variants`` of ``word_counts``. Whole texts count; null texts have no words, repeated rows count as often as they
    occur, an empty table gives an empty table, and other columns are ignored."""
    if length < 2:
        raise ValueError("words of one character are all near each other")
    return variants(word_counts(docs, key, text, every, length, least), dominance)
