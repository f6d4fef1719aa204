"""Table layouts and the checks made against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = T.StructType([
    T.StructField("user_id", T.IntegerType()),
    T.StructField("item_id", T.IntegerType()),
    T.StructField("rating", T.FloatType()),
])

RATINGS_CSV = T.StructType([
    T.StructField("userId", T.StringType()),
    T.StructField("movieId", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])

ITEMS_CSV = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])

USERS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("item_ids", T.StringType()),
    T.StructField("job_status", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("html", T.StringType()),
])

ITEM_FACTORS = T.StructType([
    T.StructField("item_id", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.FloatType())),
])

RECOMMENDATIONS = T.StructType([
    T.StructField("user_id", T.IntegerType()),
    T.StructField("item_id", T.IntegerType()),
    T.StructField("prediction", T.FloatType()),
    T.StructField("link", T.StringType()),
    T.StructField("image_link", T.StringType()),
    T.StructField("rank", T.IntegerType()),
])


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of ``schema`` by name; a missing column is an error."""
    require_columns(df, schema.names)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
