"""Benchmark decontamination: windows of benchmark words are looked up in every window of the documents.

DataFrame functions only. The benchmark's windows are hashed over lower-cased words, which finds a superset of the wanted
matches, and the set of hashes is broadcast as a bounded array of bits. A document's windows are hashed by doubling, and
only their places and hashes leave its row, without its words; the few that the set and then the table of hashes know are
taken back to their documents and verified word by word with only A-Z folded. For that step documents without a hit stay
where they are: a second set of bits, of the hit texts, is tested in their scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateweave.llm.common import ascii_lower, saved, text_or_empty
from rateweave.operators.membership import KEYS_PER_WORD, key_bits, may_contain, maybe

WINDOW = 10
#: Windows that the broadcast set of hashes is made for, at 16 bits a window (16 MB at most). With more windows it lets
#: more other windows pass to the verifying join, which has the last word at every size.
MOST_BROADCAST = 8_000_000
SEPARATORS = "[\\x00-/:-@\\[-`{-\\x7F]+"
WORD_CHARS = "[^\\x00-/:-@\\[-`{-\\x7F]"


def content_words(text: Column) -> Column:
    """Words of ASCII letters, digits and anything beyond ASCII; case as in the text."""
    def inner(parts):
        # only the first and the last part of a split can be empty
        first = F.when(parts[0] == "", 1).otherwise(0)
        last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, first + 1, F.size(parts) - first - last)

    return F.transform(F.array(F.split(text, SEPARATORS)), inner)[0]


def _pairs(a: Column, b: Column, k: int) -> Column:
    """A hash of ``a[i]`` and ``b[i + k]`` for every place that both have."""
    n = F.greatest(F.size(b) - k, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(k + 1), n), lambda x, y: F.xxhash64(x, y))


def window_hashes(words: Column, length: int) -> Column:
    """A hash of every run of ``length`` words; empty if there are fewer words.

    Hashes of 1, 2, 4, ... words are made from two of half the length, and those that ``length`` is the sum of are put
    together, so the work for a window grows with the logarithm of its length.
    """
    def grown(power: Column, size: int, held: Column | None, n: int) -> Column:
        if length & size:
            held = power if held is None else _pairs(held, power, n)
            n += size
        if n == length:
            return held
        bound = [_pairs(power, power, size).alias("power")] + ([] if held is None else [held.alias("held")])
        # bound, so that what is read twice is made once
        return F.transform(F.array(F.struct(*bound)), lambda s: grown(
            s["power"], 2 * size, None if held is None else s["held"], n))[0]

    single = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(single), lambda s: grown(s, 1, None, 0))[0]


def _run(words: Column, at: Column, length) -> Column:
    return ascii_lower(F.array_join(F.slice(words, at + 1, length), " "))


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(length, h, run, item)``, distinct: every window of every item; an item of fewer words is one window."""
    content = text_or_empty(text)
    cut = items.filter(F.col(key).isNotNull()).select(F.col(key).alias("item"), content_words(content).alias("words"),
                                                      content_words(F.lower(content)).alias("low")).filter(F.size("words") > 0)
    found = None
    for length in range(1, window + 1):
        of_length = cut.filter((F.size("words") >= length) if length == window else (F.size("words") == length))
        at = of_length.select("item", "words", F.posexplode(window_hashes(F.col("low"), length)).alias("at", "h"))
        some = at.select(F.lit(length).alias("length"), "h", _run(F.col("words"), F.col("at"), length).alias("run"), "item")
        found = some if found is None else found.union(some)
    return found.distinct()


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``(key, text_hash, n_hit, hit_words, items)`` for documents with a verified window.

    ``hit_words`` are the positions of words inside any occurrence, ``items`` the distinct ids of the items that occur.
    """
    table = saved(benchmark_windows(items, item_key, item_text, window), "windows")
    lengths = sorted(r[0] for r in table.select("length").distinct().collect())  # at most ``window`` numbers
    content = text_or_empty(text)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(content).alias("text_hash"), content.alias("content"))
    low = content_words(F.lower("content"))
    near = rows.filter("false").select("key", "text_hash", F.lit(0).alias("length"), F.lit(0).alias("at"))
    for length in lengths:
        hashes = table.filter(F.col("length") == length).select("h").distinct()
        bits, n = key_bits(hashes, "h", most_broadcast // KEYS_PER_WORD)
        seen = rows.select("key", "text_hash", F.posexplode(window_hashes(low, length)).alias("at", "h"))
        known = seen.filter(maybe(bits, n, F.col("h"))).join(hashes, "h")
        near = near.union(known.select("key", "text_hash", F.lit(length), "at"))
    # repeated rows have the same places
    near = saved(near.distinct(), "near")
    places = near.groupBy(F.col("key").alias("key_2"), F.col("text_hash").alias("hash_2")).agg(
        F.collect_list(F.struct("length", "at")).alias("places"))
    some = rows.filter(may_contain(near.select("text_hash").distinct(), "text_hash", F.col("text_hash"), most_broadcast // KEYS_PER_WORD))
    met = some.join(places, [F.col("key").eqNullSafe(F.col("key_2")), F.col("text_hash") == F.col("hash_2")])
    bound = F.struct(content_words(F.col("content")).alias("words"), F.col("places").alias("places"))
    texts = F.transform(F.array(bound), lambda b: F.transform(b["places"], lambda p: F.struct(
        p["length"].alias("length"), p["at"].alias("at"), _run(b["words"], p["at"], p["length"]).alias("run"))))[0]
    # equal runs of one length are the verified hits; several items may share one
    runs = table.select("length", "run").distinct()
    found = met.select("key", "text_hash", F.inline(texts)).join(runs, ["length", "run"]).withColumnRenamed("run", "wanted")
    # repeated rows find the same places again
    found = saved(found.distinct(), "hits")
    spots = found.withColumn("word", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)))
    words = spots.groupBy("key", "text_hash").agg(
        F.array_sort(F.collect_set("word")).alias("hit_words"))
    owners = table.select(F.col("run").alias("wanted"), "item")
    named = found.select("key", "text_hash", "wanted").distinct().join(owners, "wanted")
    items_of = named.groupBy("key", "text_hash").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    same = [F.col("key").eqNullSafe(F.col("key_2")), F.col("text_hash") == F.col("hash_2")]
    both = words.join(items_of.withColumnsRenamed({"key": "key_2", "text_hash": "hash_2"}), same)
    return both.select("key", "text_hash", F.size("hit_words").cast("long").alias("n_hit"), "hit_words", "items")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``.

    A null or blank text has no words and is clean; so is everything when the benchmark is empty. Items without words
    or without an id are ignored, an item of fewer words than a window matches as a whole. Repeated rows get the same answer each, also
    with null ids; rows with one id and different texts are judged apart. ``items_sha256`` is over the ids of the
    occurring items, sorted as strings and joined by commas. Other columns are ignored.
    """
    found = hits(docs, items, key, text, **how).select(F.col("key").alias("_key_2"), "text_hash", "n_hit", "items")
    content = text_or_empty(text)
    count = F.size(content_words(content)).cast("long")
    all_rows = docs.select(key, F.xxhash64(content).alias("hash_1"), count.alias("n_words"))
    same = [F.col(key).eqNullSafe(F.col("_key_2")), F.col("hash_1") == F.col("text_hash")]
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    named = F.coalesce("items", F.array().cast("array<string>"))
    return all_rows.join(found, same, "left").select(
        key, "n_words", n_hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_places(pieces: Column, places: Column) -> Column:
    """The pieces joined, but for those at ``places`` (ascending, from 0), in time linear in both."""
    def kept(bound):
        ends = bound["ends"]
        # what lies between two places that go
        between = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.slice(
            bound["pieces"], F.get(ends, i - 1) + 2, F.get(ends, i) - F.get(ends, i - 1) - 1))
        return F.array_join(F.flatten(between), "")

    def ended(bound):
        return F.struct(bound["pieces"].alias("pieces"), F.concat(
            F.array(F.lit(-1)), bound["places"], F.array(F.size(bound["pieces"]))).alias("ends"))

    bound = F.transform(F.array(F.struct(pieces.alias("pieces"), places.alias("places"))), ended)
    return F.transform(bound, kept)[0]


def cleaned(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", most_hit: float = 0.3,
            **how) -> DataFrame:
    """``docs`` without benchmark passages, in the same columns.

    A document with more than ``most_hit`` of its words inside occurrences goes; from others the hit words are removed,
    each with the separators before it. Clean documents keep their exact text. Nulls and repeats as in
    :func:`contamination`.
    """
    found = hits(docs, items, key, text, **how).select(
        F.col("key").alias("_dc_key"), F.col("text_hash").alias("_dc_hash"), F.col("hit_words").alias("_dc_words"))
    content = text_or_empty(text)
    met = docs.join(found, [F.col(key).eqNullSafe(F.col("_dc_key")), F.xxhash64(content) == F.col("_dc_hash")], "left")
    most = most_hit * F.size(content_words(content))
    met = met.filter(F.when(F.col("_dc_words").isNull(), F.lit(True)).otherwise(F.size("_dc_words") <= most))
    # every word with what stands before it, then what stands after the last word
    pieces = F.regexp_extract_all(content, F.lit(f"{SEPARATORS[:-1]}*{WORD_CHARS}+|{SEPARATORS}"), F.lit(0))
    new = {text: F.when(F.col("_dc_words").isNotNull(), without_places(pieces, F.col("_dc_words"))).otherwise(F.col(text))}
    out = met.withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_dc_words").isNotNull(), F.length(text)).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
