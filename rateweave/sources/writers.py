"""Sinks for results, factors, users and the ledger of processed users.

Results and ledger are written one folder per run and a run replaces its own folder, so repeating a run
changes nothing. The ledger is written after the results: a run that fails in between is simply repeated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateweave import schemas


def _run_path(path: str, run_id: str) -> str:
    if not run_id or "/" in run_id or "=" in run_id:
        raise ValueError(f"not usable as a run id: {run_id!r}")
    return f"{path.rstrip('/')}/run_id={run_id}"


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    df.write.mode("overwrite").parquet(_run_path(path, run_id))


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """All runs with their ``run_id``; an absent folder is an empty table."""
    full = T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def write_recommendations(df: DataFrame, path: str, run_id: str) -> None:
    write_run(df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RECOMMENDATIONS]),
              path, run_id)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, parts: int | None = None) -> None:
    """Append in one set-at-a-time write; ``parts`` bounds the number of connections.

    Each partition is one transaction. A task that is lost after its commit is run again, so the table should
    have a unique key (run, user and item for recommendations).
    """
    (df.coalesce(parts) if parts else df).write.jdbc(url, table, mode="append", properties=properties or {})


def append_users(users: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """Append accepted sign-ups ``(id, name, ...)``, over as many connections as there are partitions."""
    append_jdbc(users, url, table, properties)


def export_item_factors(factors: DataFrame, path: str) -> None:
    """One row per item holding its id and vector; nothing passes through the driver."""
    factors.select("item_id", "features").write.mode("overwrite").parquet(path)


def processed_users(spark: SparkSession, ledger: str) -> DataFrame:
    return read_runs(spark, ledger, T.StructType([T.StructField("user_id", T.IntegerType())]))


def mark_processed(users: DataFrame, ledger: str, run_id: str) -> None:
    """Written in order of the ids, so that a later look-up of other ids skips the files by their statistics."""
    write_run(users.select(F.col("id").cast("int").alias("user_id")).distinct().orderBy("user_id"), ledger, run_id)


def not_yet_processed(users: DataFrame, ledger: DataFrame, run_id: str) -> DataFrame:
    """Users no other run has processed; a repeated run sees the same users as the first time."""
    others = ledger.filter(F.col("run_id") != run_id).select(F.col("user_id").alias("id"))
    return users.join(others, "id", "left_anti")


def write_picks(users: DataFrame, picks: DataFrame) -> DataFrame:
    """The users table with ``item_ids`` taken from ``picks(user_id, item_ids)`` where given."""
    new = picks.select(F.col("user_id").alias("id"), F.col("item_ids").alias("_picked"))
    return users.join(new, "id", "left").withColumn("item_ids", F.coalesce("_picked", "item_ids")).drop("_picked")
