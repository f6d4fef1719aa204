"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the most frequent chunks of the corpus (see ``pretokens``) and their token counts, sent
to every worker once. Tier two is each worker's own cache, filled by the tokenizers library. No chunk is ever shuffled:
what travels is a bounded summary of every task's most frequent chunks, from which the table is made, and the results.
"""

from __future__ import annotations

import heapq
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.llm.bpe import _parts, arrow_type, read_vocabulary
from rateweave.llm.common import worker_cache
from rateweave.llm.pretokens import library_ids

#: Rows of the frequent table, of a task's summary, and counters a task holds before it drops the rarest.
TABLE, SUMMARY, HELD = 32_768, 8_192, 400_000
#: Longer chunks are never frequent; this bounds the table's bytes.
LONGEST = 48


def frequent_chunks(docs: DataFrame, text: str = "text", table: int = TABLE, summary: int = SUMMARY) -> list[str]:
    """At most ``table`` chunks that follow a space, the most frequent first.

    Every text is counted. A task keeps at most ``HELD`` counters (the rarest half goes when there are more) and reports
    its ``summary`` most frequent chunks; the reports are added up. So the list is close to the true ranking but need
    not equal it, which only matters for speed: what the table lacks the other tier answers.
    """
    def run(batches):
        import re

        cut = re.compile(r" (?=\S)").split
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(cut(t.as_py() or "")[1:])
                if len(counts) > HELD:
                    counts = Counter(dict(heapq.nlargest(HELD // 2, counts.items(), key=itemgetter(1))))
        top = heapq.nlargest(summary, ((c, n) for c, n in counts.items() if len(c) <= LONGEST), key=itemgetter(1, 0))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                         names=["chunk", "n"])

    reports = docs.select(F.col(text).cast("string")).mapInArrow(run, "chunk string, n bigint")
    best = reports.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(table)
    return [r.chunk for r in best.select("chunk").collect()]


def compact(chunks: list[str], data: bytes) -> tuple[bytes, bytes, bytes]:
    """Chunks as one UTF-8 string, their byte lengths and their token counts (16 bits each)."""
    known = library_ids(data)
    known.learn(set(), set(chunks))
    raw = [c.encode() for c in chunks]
    counts = [len(known.later[c]) // 4 for c in chunks]
    return b"".join(raw), np.array([len(x) for x in raw], np.uint16).tobytes(), np.array(counts, np.uint16).tobytes()


def _opened(packed) -> dict[str, int]:
    text, sizes, counts = packed
    ends = np.cumsum(np.frombuffer(sizes, np.uint16), dtype=np.int64).tolist()
    return {text[a:b].decode(): n for a, b, n in zip([0, *ends], ends, np.frombuffer(counts, np.uint16).tolist())}


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512,
                 table: int = TABLE) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for every row of ``docs``, by the tokenizer file at ``path``.

    A null text is an empty one: no bytes, no tokens. Special tokens' strings inside texts count as the library takes
    them by default. Rows do not influence each other, so repeated rows and null keys come out as they went in; an empty
    table gives an empty table; other columns are ignored.
    """
    data = read_vocabulary(path)
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(data)
    packed = context.broadcast(compact(frequent_chunks(docs, text, table), data))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        library = library_ids(vocabulary.value)
        tiers = worker_cache("token_count_tiers", dict)  # the last table and file, and what was asked of the library
        name = vocabulary.value, packed.value
        if tiers.get("name") != name:
            tiers.update(name=name, common=_opened(packed.value), seen={})
        common, seen = tiers["common"], tiers["seen"]
        for part in _parts(batches):
            texts = [t for _, t in part]
            whole = [library.whole(t) for t in texts]
            cut = [library.chunks(t) if w is None else None for t, w in zip(texts, whole)]
            rest = [c for c in cut if c is not None]
            missed = {x for c in rest for x in c[1:] if x not in common and x not in seen}
            if len(seen) > 2 * HELD:
                seen.clear()
                missed = {x for c in rest for x in c[1:] if x not in common}
            library.learn({c[0] for c in rest}, missed)
            seen.update((x, len(library.later.pop(x)) // 4) for x in missed)

            def count(chunks):
                got = list(map(common.get, chunks))
                n = len(library.first[chunks[0]]) // 4 + sum(filter(None, got[1:]))
                return n + sum([seen[x] for x, known in zip(chunks[1:], got[1:]) if known is None])

            counts = [len(w) // 4 if c is None else count(c) for c, w in zip(cut, whole)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], arrow_type(kind)), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(counts, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    counted = docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
