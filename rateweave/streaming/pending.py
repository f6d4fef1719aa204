"""The recurring job: recommendations for the users who became pending since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from rateweave import schemas
from rateweave.plans.catalog import SEED_LAST_USER, pending_users
from rateweave.session import cut_lineage
from rateweave.sources import writers

# Fixed value: how often the job looks for new users.
POLL_INTERVAL = "15 minutes"


def read_selections(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Stream of user rows with their picks, from files dropped into a folder."""
    return spark.readStream.schema(schemas.USERS).format(file_format).load(path)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query when it made the checkpoint."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def _unseen(waiting: DataFrame) -> DataFrame:
    """The rows of users whose id no earlier micro-batch held; which ids were there is the query's keyed state.

    A micro-batch reads and writes the state of its own users only, so its cost does not grow with the users of the past.
    """
    def first_time(key, frames, state):
        if not state.exists:
            state.update((True,))
            yield from frames

    return waiting.groupBy("id").applyInPandasWithState(
        first_time, waiting.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def run_pending(selections: DataFrame, recommend: Callable[[DataFrame], DataFrame], results: str, ledger: str,
                checkpoint: str, exclude_ids: tuple[int, ...] = (SEED_LAST_USER,), name: str = "pending",
                continuous: bool = False, newest_by: str | None = None) -> StreamingQuery:
    """Start the job on a stream of user rows.

    Users this query has seen are dropped by its keyed state, users that other queries have processed by their part of the
    ledger, of which only the range of the waiting ids is read. Each micro-batch calls ``recommend(pending)`` once for all
    its users, writes the results and then the ledger, both under the batch's run id. A batch that is replayed after a
    failure starts from the state before it, sees the same users and replaces its own files. The run id holds the query's
    own id, which lasts as long as its checkpoint, so queries with other checkpoints can share the folders. Of a user sent
    twice in one batch the row with the largest ``newest_by`` counts (equal or no such column: the largest list). The query
    ends when all present files are processed; with ``continuous`` it polls every 15 minutes instead.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = f"{name}-{_query_id(spark, checkpoint)}-"
        one = cut_lineage(batch.groupBy("id").agg(F.max_by("item_ids", F.struct("_newest", "item_ids")).alias("item_ids")))
        low, high = one.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return
        others = writers.processed_users(spark, ledger).filter(
            ~F.col("run_id").startswith(run) & F.col("user_id").between(low, high))
        run_id = f"{run}{batch_id:08d}"
        todo = cut_lineage(writers.not_yet_processed(one, others, run_id))
        if todo.isEmpty():
            return
        writers.write_recommendations(recommend(todo), results, run_id)
        writers.mark_processed(todo, ledger, run_id)

    newest = F.col(newest_by) if newest_by else F.lit(0)
    fresh = _unseen(pending_users(selections, exclude_ids, [newest.alias("_newest")]))
    writer = fresh.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(processingTime=POLL_INTERVAL) if continuous else writer.trigger(availableNow=True)
    return writer.start()
