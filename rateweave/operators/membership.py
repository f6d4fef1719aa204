"""A Bloom filter as an aggregate, for filtering a scan by keys that are known before it starts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys for one 64-bit word, bits of a key in its word, and the most words of a filter (1 MB): with more keys it lets more
#: rows pass.
KEYS_PER_WORD, DRAWS, MOST_WORDS = 4, 4, 1 << 17


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key and its bits there."""
    drawn = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(drawn, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(DRAWS)]
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int"), reduce(lambda a, b: a.bitwiseOR(b), bits)


def key_bits(keys: DataFrame, key: str, most_words: int = MOST_WORDS) -> tuple[Column, int]:
    """The filter of ``keys`` as a scalar subquery, an array of 64-bit words, and the number of its words.

    A word is the ``bit_or`` of its keys' bits; the array's size is bounded, whatever the number of keys.
    """
    words = max(1, min(most_words, keys.count() // KEYS_PER_WORD))
    word, bits = _place(F.col(key), words)
    masks = keys.filter(F.col(key).isNotNull()).groupBy(word.cast("bigint").alias("id")).agg(F.bit_or(bits).alias("mask"))
    every = keys.sparkSession.range(words).join(masks, "id", "left")
    entry = F.struct("id", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))
    array = F.transform(F.array_sort(F.collect_list(entry)), lambda w: w["mask"])
    return every.agg(array.alias("words")).scalar(), words


def maybe(array: Column, words: int, value: Column) -> Column:
    """Does the filter know ``value``? It does for all its keys and for few other values."""
    word, bits = _place(value, words)
    return F.get(array, word).bitwiseAND(bits) == bits


def may_contain(keys: DataFrame, key: str, column: Column, most_words: int = MOST_WORDS) -> Column:
    """A condition that holds for every value of ``column`` found in ``keys``, for few others, and not for null.

    Spark computes the filter once, before the scan that tests it. ``column`` has the type of the keys.
    """
    return column.isNotNull() & maybe(*key_bits(keys, key, most_words), column)
