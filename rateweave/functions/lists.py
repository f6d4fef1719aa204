"""Rows from list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_lists(df: DataFrame, columns: list[str], fill_value=None, position: str | None = None) -> DataFrame:
    """Explode several list columns in step; a row whose lists are empty stays, holding ``fill_value``.

    Lists of one row must have equal lengths, otherwise the query fails. ``position`` adds the
    zero-based place in the list (0 for an empty one), so that the order can be restored.
    """
    if not columns:
        raise ValueError("name at least one list column")
    def length(name: str) -> Column:
        return F.greatest(F.coalesce(F.size(F.col(name)), F.lit(0)), F.lit(0))

    first = length(columns[0])
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    for other in columns[1:]:
        zipped = F.when(length(other) == first, zipped).otherwise(
            F.raise_error(F.concat(F.lit(f"lists {columns[0]} and {other} differ in length: "),
                                   first.cast("string"), F.lit(" and "), length(other).cast("string"))))
    kept = [F.col(c) for c in df.columns if c not in columns]
    rows = df.select(*kept, F.posexplode_outer(zipped).alias("_pos", "_row"))

    def value(name: str) -> Column:
        element = F.col("_row").getField(name)
        if fill_value is None:
            return element
        return F.when(F.col("_pos").isNull(), F.lit(fill_value)).otherwise(element)

    out = [F.col(c) if c not in columns else value(c).alias(c) for c in df.columns]
    if position:
        out.append(F.coalesce(F.col("_pos"), F.lit(0)).alias(position))
    return rows.select(*out)
