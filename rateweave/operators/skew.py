"""Splitting of hot keys.

A key that holds a large share of the rows is cut into splits: the large side gets a split number
from a hash of its other columns, the unique side is repeated once per split. Only keys above a row
threshold are touched, and the threshold is at least a ``MOST_HOT_KEYS``-th of all rows: no more keys than that
can reach it, whatever the data are, so the list of hot keys may be broadcast and nothing is cut off it. A
key below the threshold is no larger than a task's share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateweave.session import cut_lineage

MOST_HOT_KEYS = 100_000
ROWS_PER_SPLIT = 1_000_000
#: Hash buckets that are counted before keys are; a key has no more rows than its bucket.
COUNTED_BUCKETS = 1 << 14


def hot_keys(df: DataFrame, key: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame | None:
    """``(key, n_splits)`` for the most frequent keys with more than ``rows_per_split`` rows, None if there are none.

    The list is written once: both sides of a join have to see the same splits.
    """
    return hot_keys_by(df, [key], rows_per_split)[key]


def hot_keys_by(df: DataFrame, keys: list[str], rows_per_split: int = ROWS_PER_SPLIT) -> dict[str, DataFrame | None]:
    """The ``hot_keys`` of several columns; ``df`` is read for these columns only.

    A first pass counts hash buckets of the keys, so that what moves is a bounded number of rows a task instead of one
    for each key in it. Keys are counted in a second pass, in buckets with more than ``rows_per_split`` rows only, and there
    is none without such buckets. Keys with more than ``rows_per_split`` rows are written; where they are more than
    ``MOST_HOT_KEYS``, the threshold rises to the count of the last of them.
    """
    df = df.select(*keys)
    full = _full_buckets(df, keys, rows_per_split)
    if not any(full.values()):
        return dict.fromkeys(keys)
    within = [F.when(_bucket(k).isin(full[k]), F.col(k)).alias(k) if full[k] else F.lit(None).cast(df.schema[k].dataType).alias(k)
              for k in keys]
    sets = df.select(*within).groupingSets([[F.col(k)] for k in keys], *keys).agg(
        *[F.grouping(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(sets.filter(F.col("_n") > rows_per_split))
    found: dict[str, DataFrame | None] = {}
    for i, key in enumerate(keys):
        of_key = large.filter((F.col(f"_g{i}") == 0) & F.col(key).isNotNull())
        n = of_key.count()
        threshold = rows_per_split
        if n > MOST_HOT_KEYS:
            threshold = of_key.orderBy(F.desc("_n")).limit(MOST_HOT_KEYS + 1).agg(F.min("_n")).first()[0]
        hot = of_key.filter(F.col("_n") > threshold).select(key, F.ceil(F.col("_n") / threshold).cast("int").alias("n_splits"))
        found[key] = hot if n else None
    return found


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(COUNTED_BUCKETS))


def _full_buckets(df: DataFrame, keys: list[str], rows: int) -> dict[str, list[int]]:
    """By key, the hash buckets with more than ``rows`` rows; nulls belong to none."""
    each = F.explode(F.array(*[F.when(F.col(k).isNotNull(), i * COUNTED_BUCKETS + _bucket(k)) for i, k in enumerate(keys)]))
    counted = df.select(each.alias("_b")).filter(F.col("_b").isNotNull()).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    found: dict[str, list[int]] = {k: [] for k in keys}
    for r in counted.filter(F.col("_n") > rows).select("_b").collect():
        found[keys[r[0] // COUNTED_BUCKETS]].append(r[0] % COUNTED_BUCKETS)
    return found


def with_split(df: DataFrame, key: str, hot: DataFrame, spread_by: list[str], name: str = "split") -> DataFrame:
    """Number each row's split: 0 for ordinary keys, a hash of ``spread_by`` for hot ones."""
    split = F.pmod(F.xxhash64(*spread_by), F.col("n_splits"))
    return (df.join(F.broadcast(hot), key, "left")
              .withColumn(name, F.coalesce(split, F.lit(0)).cast("int"))
              .drop("n_splits"))


def repeat_per_split(df: DataFrame, key: str, hot: DataFrame, name: str = "split") -> DataFrame:
    """Repeat each row once per split of its key."""
    splits = F.sequence(F.lit(0), F.coalesce(F.col("n_splits"), F.lit(1)) - 1)
    return (df.join(F.broadcast(hot), key, "left")
              .withColumn(name, F.explode(splits))
              .drop("n_splits"))


def split_join(big: DataFrame, unique: DataFrame, key: str, spread_by: list[str], how: str = "inner",
               rows_per_split: int = ROWS_PER_SPLIT, hot: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """Join ``big`` to a table with one row per ``key`` without sending a hot key to one task.

    ``hot`` holds the hot keys where they are known already, from ``big`` or from rows that it was made of.
    """
    of_key = hot[key] if hot is not None else hot_keys(big, key, rows_per_split)
    if of_key is None:
        return big.join(unique, key, how)
    left = with_split(big, key, of_key, spread_by, "_split")
    right = repeat_per_split(unique, key, of_key, "_split")
    return left.join(right, [key, "_split"], how).drop("_split")
