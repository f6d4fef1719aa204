"""A stored dictionary of dense numbers that grows batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateweave.operators.ranking import global_row_number


def read_dictionary(spark: SparkSession, path: str, key_type: str, key: str = "id", through: int | None = None) -> DataFrame:
    """``(key, idx, batch)`` of all batches, or of those up to ``through``; an absent folder is an empty dictionary."""
    schema = f"`{key}` {key_type}, idx bigint, batch bigint"
    try:
        found = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return found if through is None else found.filter(F.col("batch") <= through)


def grow_dictionary(df: DataFrame, path: str, batch: int, key: str, order: list[str]) -> DataFrame:
    """The dictionary through ``batch``, in which every value of ``key`` that ``df`` brings anew has got a number.

    Known values keep their numbers. New ones follow after the largest number, in the order of their first appearance by
    ``order`` (then by value), without gaps; null has none. Batches have ascending numbers and folders of their own: a
    batch that is repeated sees the batches before it only and replaces what it wrote, so it gives the same numbers.
    """
    spark, key_type = df.sparkSession, df.schema[key].dataType.simpleString()
    known = read_dictionary(spark, path, key_type, key, batch - 1)
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    new = first.join(known.select(key), key, "left_anti")
    start = known.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    numbered = global_row_number(new, ["_first", key], "idx", start=start)
    numbered.select(key, "idx").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return read_dictionary(spark, path, key_type, key, batch)
