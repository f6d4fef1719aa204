"""Readers for files and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateweave import schemas
from rateweave.schemas import cast_to, require_columns


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header and an explicit schema; a file whose header differs is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.ITEMS_CSV).withColumnRenamed("movieId", "item_id")


def read_ratings_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed ratings with ``rated_at`` in epoch seconds, and the rows whose values would not parse."""
    raw = (read_csv(spark, path, schemas.RATINGS_CSV)
           .withColumnsRenamed({"userId": "user_id", "movieId": "item_id", "timestamp": "rated_at"}))
    return typed_ratings(raw)


def typed_ratings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: the triple cast by name; rows with a value that does not cast are rejected."""
    require_columns(raw, schemas.RATINGS.names)
    types = {f.name: f.dataType for f in schemas.RATINGS}
    cast = {n: F.col(n).cast("string").try_cast(types[n]) if raw.schema[n].dataType.typeName() == "string"
            else F.col(n).cast(types[n]) for n in types}
    bad = F.lit(False)
    for n, c in cast.items():
        bad = bad | (F.col(n).isNotNull() & c.isNull())
    others = [F.col(c) for c in raw.columns if c not in types]
    return raw.filter(~bad).select(*[c.alias(n) for n, c in cast.items()], *others), raw.filter(bad)


def jdbc_bounds(spark: SparkSession, url: str, table: str, column: str, properties: dict) -> tuple[int, int] | None:
    """Smallest and largest value of ``column``; the database answers with one row."""
    query = f"(select min({column}) as lo, max({column}) as hi from {table}) bounds"
    row = spark.read.jdbc(url, query, properties=properties).first()
    return None if row is None or row[0] is None else (int(row[0]), int(row[1]))


def range_predicates(column: str, low: int, high: int, parts: int) -> list[str]:
    """Disjoint conditions that cover every value of ``column``, nulls included."""
    if parts < 1 or low > high:
        raise ValueError("need at least one part and low <= high")
    step = max(1, -(-(high - low + 1) // parts))
    cuts = list(range(low + step, high + 1, step))
    if not cuts:
        return ["1 = 1"]
    middle = [f"{column} >= {a} and {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} or {column} is null", *middle, f"{column} >= {cuts[-1]}"]


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 1,
              bounds: tuple[int, int] | None = None, properties: dict | None = None) -> DataFrame:
    """Scan a database table, over ``parts`` connections when a numeric ``column`` is named."""
    properties = properties or {}
    if column and parts > 1:
        bounds = bounds or jdbc_bounds(spark, url, table, column, properties)
        if bounds:
            return spark.read.jdbc(url, table, predicates=range_predicates(column, *bounds, parts),
                                   properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def load_table(df: DataFrame, parts: int | None = None, key: str = "item_id") -> DataFrame:
    """Ratings are cast to their types, other tables pass; ``parts`` spreads the rows by ``key``.

    Spread only what is read more than once: the scan's own partitions do for a single pass.
    """
    if "rating" in df.columns:
        df = cast_to(df, schemas.RATINGS)
    return df.repartition(parts, key) if parts else df


def read_item_factors(spark: SparkSession, path: str) -> DataFrame:
    return cast_to(spark.read.parquet(path), schemas.ITEM_FACTORS)
