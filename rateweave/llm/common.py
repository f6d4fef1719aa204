"""What the operators share: reading a table, folders, ASCII word rules, caches of Python workers."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateweave.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read again; survives lost executors and is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array where there is none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[ \\t-\\r]+"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def worker_cache(name: str, make):
    """An object that lives as long as the Python worker, whatever tasks it runs."""
    held = sys.modules.setdefault("_rateweave_worker_cache", types.ModuleType("_rateweave_worker_cache"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def text_sample(docs: DataFrame, text: str, rows: int, characters: int) -> list[str]:
    """At most ``rows`` pieces of at most ``characters`` characters from the middle of different texts, by a hash of the text.

    The hash limit comes from the number of different texts, so what leaves the tasks is a few times ``rows`` pieces, not
    that many a task, and a text that fills a third of the table counts once.
    """
    c = F.col(text).cast("string")
    hashed = docs.filter(F.length(c) > 0).select(F.xxhash64(c).alias("h"), c.alias("t"))
    different = hashed.agg(F.approx_count_distinct("h")).first()[0]
    limit = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 4 * rows / max(different, 1))))
    middle = F.greatest((F.length("t") / 2).cast("int") - characters // 2, F.lit(1))
    few = hashed.filter(F.col("h") <= limit).groupBy("h").agg(F.min(F.substr("t", middle, F.lit(characters))).alias("s"))
    return [r.s for r in few.orderBy("h").limit(rows).collect()]
