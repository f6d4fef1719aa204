"""Row numbers, top-k and relative order without single-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateweave.session import cut_lineage


def global_row_number(df: DataFrame, order: list[Column | str], name: str = "row_number",
                      start: int = 1) -> DataFrame:
    """Number all rows in ``order``, which has to be unique per row.

    Rows are range-partitioned, sorted where they are and written once, each with its partition and its place in it.
    The offsets are a running sum over one row per partition, so the only ordered single-task step is as small as the
    partition count, and rows are shuffled once.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    # the upper bits of this number are the partition, the lower 33 the place in it
    ranged = cut_lineage(df.repartitionByRange(*columns).sortWithinPartitions(*columns)
                           .withColumn("_place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    per_part = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (ranged.withColumn("_part", part)
                  .join(F.broadcast(offsets), "_part")
                  .withColumn(name, (F.col("_offset") + inside + start).cast("bigint"))
                  .drop("_part", "_place", "_offset"))


def top_k_per_key(df: DataFrame, key: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key with their rank.

    Spark trims each map partition to ``k`` rows per key before the shuffle, so a hot key arrives small.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= k)


def relative_sort(a: DataFrame, b: DataFrame) -> DataFrame:
    """Order the values of ``a`` like ``b``, list by list.

    ``a`` is ``(list_id, pos, value)`` and ``b`` is ``(list_id, pos, value)``. Slots of ``a`` whose value
    occurs in ``b`` are refilled in the order of ``b`` (its last occurrence counts); the other slots
    become null in place.

    Slots and values of one list are equally many, so numbering each of them over all lists gives every
    list the same run of numbers, and one equi join on the number pairs them. No list is ever gathered.
    """
    ranks = b.groupBy("list_id", "value").agg(F.max("pos").alias("_rank"))
    present = cut_lineage(a.join(ranks, ["list_id", "value"]))
    slots = global_row_number(present.select("list_id", "pos"), ["list_id", "pos"], "_i")
    values = global_row_number(present.select("list_id", "_rank", F.col("pos").alias("_from"), "value"),
                               ["list_id", "_rank", "_from"], "_i").select("_i", "value")
    filled = slots.join(values, "_i").select("list_id", "pos", "value")
    return a.select("list_id", "pos").join(filled, ["list_id", "pos"], "left")
