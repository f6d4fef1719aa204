"""Substring deduplication over sliding sentence spans.

Texts are cut into sentences (and clauses: a copied passage seldom starts where a sentence does), and clauses of more
than ``LONGEST`` words at words that their neighbours choose, see ``_inner_cuts``. From every sentence a span runs over at
least ``RUN`` sentences and on until it has ``WORDS`` words; a text too short for that is one span if it has the words.
Spans are hashed to 128 bits and counted over the whole corpus. The first occurrence of a span, by document id and
position, stays; the sentences under every other occurrence are removed.

Two copies of a passage have the same cuts but for its first and last ``LONGEST - 1`` words, and a cut in every ``LONGEST``
words. So a span of at most ``RUN * LONGEST`` words starts within the first ``2 * LONGEST - 1`` words, and every repeat of
6 * 8 - 1 = 47 words or more shares one, wherever it is cut off.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.llm.common import saved

RUN, WORDS, LONGEST = 3, 12, 8
#: A task hands its spans on when it has so many.
SPANS_HELD = 20_000
_CLOSING = r"""["'”’»›)\]}」』）】〉》]*+"""
#: Stops before a blank, stops of scripts that need none, line ends.
_CUT = re.compile(rf"[.!?,;:…]{_CLOSING}\s+|[。！？；，、：．｡､।॥؟،؛۔։።፣፤፥།၊။។៕]{_CLOSING}\s*|\n\s*")
#: Scripts without blanks between words (Thai to Myanmar, Khmer, kana, ideographs); each character counts as a word.
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_DENSE_WORD = re.compile(rf"[{_DENSE}][^\s\w{_DENSE}]*|[^\s{_DENSE}]+")
_WORD = re.compile(r"\S+")


def words_of(part: str) -> list[str]:
    return _DENSE_WORD.findall(part) if not part.isascii() and _HAS_DENSE.search(part) else part.split()


def _inner_cuts(words: list[str]) -> list[int]:
    """Where a long clause is cut: before the word of least hash (the last of equals) of every ``LONGEST`` in a row.

    The choice depends on these words alone, so copies are cut alike wherever they stand, and no piece is longer.
    """
    import xxhash

    hashes = [1 << 64, *map(xxhash.xxh3_64_intdigest, words[1:])]  # the first word has a cut already
    cuts, at, least = [], 0, 1 << 64
    for end in range(LONGEST, len(words)):
        first, last = end - LONGEST + 1, at
        if at < first:
            near = hashes[end:first - 1:-1]
            least = min(near)
            at = end - near.index(least)
        elif hashes[end] <= least:
            at, least = end, hashes[end]
        if at != last:
            cuts.append(at)
    return cuts


def _clauses(text: str):
    """``(clause with what follows it, its words, numbers of the words before which it is cut)``, in order."""
    ends = [m.end() for m in _CUT.finditer(text)]
    if ends and text[:ends[0]].isspace():
        del ends[0]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    start = 0
    for end in ends:
        part = text[start:end]
        words = words_of(part)
        yield part, words, _inner_cuts(words) if len(words) > LONGEST else ()
        start = end


def sentences(text: str) -> list[str]:
    """Sentences, clauses and pieces of long clauses with what follows them; joined, they are the text."""
    out = []
    for part, words, cuts in _clauses(text):
        if cuts:
            at = 0
            starts = [m.start() for m in (_DENSE_WORD if _HAS_DENSE.search(part) else _WORD).finditer(part)]
            for k in cuts:
                out.append(part[at:starts[k]])
                at = starts[k]
            part = part[at:]
        out.append(part)
    return out


def sentence_words(text: str) -> list[list[str]]:
    """The words of every one of ``sentences``."""
    out = []
    for _, words, cuts in _clauses(text):
        at = 0
        for k in cuts:
            out.append(words[at:k])
            at = k
        out.append(words[at:] if at else words)
    return out


def spans(counts: list[int], run: int = RUN, words: int = WORDS) -> list[tuple[int, int]]:
    """``(first, end)`` sentence numbers of every span, from the sentences' numbers of words."""
    if len(counts) < run:
        return [(0, len(counts))] if sum(counts) >= words else []
    out, end, total = [], 0, 0
    for first in range(len(counts)):
        while end < len(counts) and (end - first < run or total < words):
            total += counts[end]
            end += 1
        if end - first < run or total < words:
            break
        out.append((first, end))
        total -= counts[first]
    return out


def hashed_spans(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``(doc_id, text_hash, h1, h2, place)`` from ``docs(doc_id, text_hash, text)``; ``place`` packs first and end."""
    def work(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            owner, places, hashes = [], [], []

            def made():
                rows = pa.array(owner, pa.int64())
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.ascontiguousarray(both[:, 0])),
                     pa.array(np.ascontiguousarray(both[:, 1])), pa.array(places, pa.int64())],
                    names=["doc_id", "text_hash", "h1", "h2", "place"])

            for row, text in enumerate(batch.column(2)):
                own = sentence_words(text.as_py() or "")
                bare = [" ".join(w).encode() for w in own]
                found = spans(list(map(len, own)), run, words)
                # a text has as many spans as it is long, so no more than some are held as Python's objects
                for at in range(0, len(found), SPANS_HELD):
                    part = found[at:at + SPANS_HELD]
                    owner += [row] * len(part)
                    places += [a << 32 | b for a, b in part]
                    hashes += [digest(b"\0".join(bare[a:b])) for a, b in part]
                    if len(places) >= SPANS_HELD:
                        yield made()
                        owner, places, hashes = [], [], []
            if places:
                yield made()

    return docs.mapInArrow(work, "doc_id bigint, text_hash bigint, h1 bigint, h2 bigint, place bigint")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """``docs`` with repeated spans removed from ``text``, and the columns ``n_sentences`` and ``n_removed`` after its own.

    A null text stays null and has no sentences; texts without a repeated span keep their exact characters. Order is by
    id (nulls first), then by a hash of the text, then by position, so ties are decided. Rows equal in id and text are
    one document: they keep and lose the same sentences. Columns of ``docs`` with the two new names are replaced. An
    empty table gives an empty table. A span that many documents share is one row before anything is joined back, and
    joins on it are split at run time.
    """
    content = F.col(text).cast("string")
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(content).alias("text_hash"), content.alias("text"))
    found = hashed_spans(own, run, words)
    place = F.struct("doc_id", "text_hash", "place")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # written, so that both sides of the join are shuffled for it alone and a passage that very many share can be split
    repeated = saved(repeated, "repeated-spans")
    later = found.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("kept")))
    gone = later.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("_sd_gone")).withColumnsRenamed(
        {"doc_id": "_sd_id", "text_hash": "_sd_hash"})
    columns = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    met = docs.select(*columns).join(
        gone, [F.col(key).cast("bigint").eqNullSafe(F.col("_sd_id")), F.xxhash64(content) == F.col("_sd_hash")], "left")
    met = met.select(*columns, "_sd_gone")
    schema = docs.select(*columns).schema.add("n_sentences", "long").add("n_removed", "long")
    at, length = columns.index(text), columns.index("n_chars") if "n_chars" in columns else None

    def work(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for value, places in zip(batch.column(at), batch.column(len(columns))):
                lost = {i for p in places.as_py() or () for i in range(p >> 32, p & 0xFFFFFFFF)}
                parts = sentences(value.as_py() or "") if lost else ()
                texts.append("".join(p for i, p in enumerate(parts) if i not in lost) if lost else value.as_py())
                counts.append(len(parts) if lost else sum(len(cuts) + 1 for *_, cuts in _clauses(value.as_py() or "")))
                removed.append(len(lost))
            out = batch.columns[:len(columns)]
            out[at] = pa.array(texts, out[at].type)
            if length is not None:
                out[length] = pa.array([len(t) if n else old for t, n, old in zip(texts, removed, out[length].to_pylist())],
                                       out[length].type)
            yield pa.RecordBatch.from_arrays([*out, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                                             names=[*columns, "n_sentences", "n_removed"])

    return met.mapInArrow(work, schema)
