"""Ratings stored twice, in tables bucketed by user and by item.

Jobs on one key read their table as it lies: joins with a table of one row per key, sums per key and the reduction to
(user, item) pairs move no rating. A key that holds many ratings is stored in splits, by a hash of the other key, so that a
bucket has a share of it only; column ``split`` is 0 for all others. Ratings without the key are spread likewise: they
stay in the table, join with nothing and belong to no sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateweave.operators.skew import ROWS_PER_SPLIT, hot_keys_by, repeat_per_split

#: A task holds the sums of a bucket's pairs.
ROWS_PER_BUCKET = 1_000_000
OTHER = {"user_id": "item_id", "item_id": "user_id"}


@dataclass(frozen=True)
class StoredRatings:
    """Two tables of a session's catalog, ``<name>_by_user`` and ``<name>_by_item``, with their files in ``folder``."""

    spark: SparkSession
    name: str
    folder: str

    def table(self, key: str) -> DataFrame:
        """The ratings, with ``split``, in the table bucketed by ``key``."""
        return self.spark.table(self._table(key))

    def _table(self, key: str) -> str:
        return f"{self.name}_by_{key.removesuffix('_id')}"

    def _path(self, what: str) -> str:
        return f"{self.folder.rstrip('/')}/{what}"

    def hot(self, key: str) -> DataFrame:
        """``(key, n_splits)`` of the keys that are stored in splits; their number is bounded as ``skew`` says."""
        return self.spark.read.parquet(self._path(f"hot_{key}"))

    def join(self, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
        """Join the ratings to a table with one row per ``key``; only that table moves."""
        right = repeat_per_split(unique, key, self.hot(key), "split")
        return self.table(key).join(right, [key, "split"], how).drop("split")

    def sums(self, key: str, *extra: str) -> DataFrame:
        """``(key, *extra, n, total)``: number and sum of the ratings that aren't null.

        Buckets are summed where they lie; what moves is a row for each key and split.
        """
        rating = F.col("rating").cast("double")
        parts = (self.table(key).filter(F.col(key).isNotNull()).groupBy(key, "split", *extra)
                     .agg(F.count("rating").alias("n"), F.sum(rating).alias("total")))
        if self.hot(key).isEmpty():
            return parts.drop("split")
        return parts.groupBy(key, *extra).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def pairs(self, key: str) -> DataFrame:
        """``(user_id, item_id, n, total)`` for every rated pair, made where the ratings lie by ``key``."""
        # the split follows from the pair, so it may be a grouping key
        return (self.table(key).filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("rating").isNotNull())
                    .groupBy("user_id", "item_id", "split")
                    .agg(F.count("rating").alias("n"), F.sum(F.col("rating").cast("double")).alias("total")).drop("split"))


def store_ratings(ratings: DataFrame, name: str, folder: str, buckets: int | None = None,
                  rows_per_split: int = ROWS_PER_SPLIT) -> StoredRatings:
    """Write ``ratings(user_id, item_id, rating, ...)`` to ``folder``, by user and by item, as tables ``name``.

    A table of that name is replaced. Every bucket is one file, sorted by key. The manifest is written last, so
    ``open_ratings`` does not see half a write.
    """
    spark = ratings.sparkSession
    if buckets is None:
        buckets = max(spark.sparkContext.defaultParallelism, -(-ratings.count() // ROWS_PER_BUCKET))
    stored = StoredRatings(spark, name, folder)
    hot = hot_keys_by(ratings, list(OTHER), rows_per_split)
    for key, other in OTHER.items():
        of_key = hot[key] if hot[key] is not None else ratings.select(key).limit(0).withColumn("n_splits", F.lit(1))
        of_key.write.mode("overwrite").parquet(stored._path(f"hot_{key}"))
        n_splits = F.when(F.col(key).isNull(), F.lit(buckets)).otherwise(F.coalesce("n_splits", F.lit(1)))
        split = F.pmod(F.xxhash64(other), n_splits).cast("int")
        rows = ratings.join(F.broadcast(stored.hot(key)), key, "left").select(*ratings.columns, split.alias("split"))
        spark.sql(f"DROP TABLE IF EXISTS {stored._table(key)}")
        # the same hash as the buckets', so a task has a whole bucket
        (rows.repartition(buckets, key, "split").write.mode("overwrite").bucketBy(buckets, key, "split")
             .sortBy(key, "split", other).option("path", stored._path(key)).saveAsTable(stored._table(key), format="parquet"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*ratings.schema, *stored.table("user_id").schema[-1:]])
    (spark.range(1).select(F.lit(columns).alias("columns"), F.lit(buckets).alias("buckets"))
          .write.mode("overwrite").parquet(stored._path("manifest")))
    return stored


def open_ratings(spark: SparkSession, name: str, folder: str) -> StoredRatings:
    """The ratings that another session stored in ``folder``, known to this session's catalog as ``name``."""
    stored = StoredRatings(spark, name, folder)
    try:
        manifest = spark.read.parquet(stored._path("manifest")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"{folder} holds no stored ratings") from e
    for key, other in OTHER.items():
        spark.sql(f"DROP TABLE IF EXISTS {stored._table(key)}")
        spark.sql(f"CREATE TABLE {stored._table(key)} ({manifest.columns}) USING parquet CLUSTERED BY ({key}, split) "
                  f"SORTED BY ({key}, split, {other}) INTO {manifest.buckets} BUCKETS LOCATION '{stored._path(key)}'")
    return stored
