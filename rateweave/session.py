"""Session defaults and lineage cutting."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins from real shuffle sizes and splits skewed join
# partitions; the library relies on it wherever a join is not salted by hand.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # a stream's keyed state outgrows the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "rateweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's defaults; resources stay with the cluster's own configuration."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset, a folder in the warehouse serves, which driver and executors share as well.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    The result survives the loss of executors and does not re-run what came before it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark remove shuffles and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which is too seldom for the disks where sweep follows sweep.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pin(df: DataFrame, keys: list[str], partitions: int, order: list[str] | None = None,
        then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write ``df`` partitioned by ``keys`` and sorted by them (or ``order``), so that later joins on them move only the other side.

    ``then`` is done to the partitioned rows before they are sorted; it has to leave them where they are. Spark remembers a
    checkpoint's partitioning only for a plan that was fixed beforehand, hence the switch.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = df.repartition(partitions, *keys)
        if then is not None:
            placed = then(placed)
        return cut_lineage(placed.sortWithinPartitions(*(order or keys)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
