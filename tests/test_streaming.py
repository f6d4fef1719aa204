import json

import pytest

from rateweave import schemas
from rateweave.plans.recommend import quick_scores
from rateweave.sources import writers
from rateweave.streaming import pending
from tests.conftest import rows


def drop(folder, name, users):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("id", "name", "item_ids", "job_status"), u))) for u in users))


def test_two_drops_a_failure_and_a_restart(spark, tmp_path):
    factors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 20)], schemas.ITEM_FACTORS)
    inbox, results, ledger, progress = (tmp_path / n for n in ("in", "results", "ledger", "progress"))
    calls = []

    def recommend(users):
        calls.append(rows(users, "id"))
        return quick_scores(users, factors, k=3).withColumnRenamed("score", "prediction")

    def run(job=recommend):
        query = pending.run_pending(pending.read_selections(spark, str(inbox)), job, str(results), str(ledger), str(progress))
        query.awaitTermination()

    def stored():
        return writers.read_runs(spark, str(results), schemas.RECOMMENDATIONS)

    drop(inbox, "1.json", [(1, "a", "2,3", None), (2, "b", None, None), (610, "s", "2", None), (3, "c", "4", "done")])
    run()
    assert rows(stored(), "user_id", "rank", "item_id") == [(1, 1, 19), (1, 2, 18), (1, 3, 17)]

    drop(inbox, "2.json", [(1, "a", "2,3", None), (4, "d", "19", None), (4, "d", "19", None)])

    def fails_after_results(users):
        # the results get written, the ledger does not
        out = recommend(users)
        mark = writers.mark_processed

        def broken(*args):
            writers.mark_processed = mark
            raise RuntimeError("lost")

        writers.mark_processed = broken
        return out

    with pytest.raises(Exception, match="lost"):
        run(fails_after_results)
    assert rows(writers.processed_users(spark, str(ledger)), "user_id") == [(1,)]
    run()
    assert calls[-2:] == [[(4,)], [(4,)]]
    assert rows(stored(), "user_id", "rank", "item_id") == [
        (1, 1, 19), (1, 2, 18), (1, 3, 17), (4, 1, 18), (4, 2, 17), (4, 3, 16)]
    assert rows(writers.processed_users(spark, str(ledger)), "user_id") == [(1,), (4,)]
    n = len(calls)
    run()
    drop(inbox, "3.json", [(1, "a", "2,3", None)])
    run()
    assert len(calls) == n


def test_two_checkpoints_share_the_folders(spark, tmp_path):
    factors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 9)], schemas.ITEM_FACTORS)
    results, ledger = str(tmp_path / "results"), str(tmp_path / "ledger")
    for n, user in (("one", 1), ("two", 2)):
        drop(tmp_path / n, "1.json", [(user, "a", "3", None)])
        pending.run_pending(pending.read_selections(spark, str(tmp_path / n)),
                            lambda users: quick_scores(users, factors, k=2).withColumnRenamed("score", "prediction"),
                            results, ledger, str(tmp_path / f"progress-{n}")).awaitTermination()
    assert rows(writers.read_runs(spark, results, schemas.RECOMMENDATIONS).select("user_id").distinct()) == [(1,), (2,)]
    assert rows(writers.processed_users(spark, ledger), "user_id") == [(1,), (2,)]


def test_the_newest_picks_of_a_user_count(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    drop(inbox, "1.json", [(1, "1", "9,9", None), (1, "2", "3", None), (1, "0", "99", None)])  # ``name`` holds the order

    def job(users):
        seen.extend(rows(users, "id", "item_ids"))
        return spark.createDataFrame([], schemas.RECOMMENDATIONS)

    pending.run_pending(pending.read_selections(spark, str(inbox)), job, str(tmp_path / "r"), str(tmp_path / "l"),
                        str(tmp_path / "p"), newest_by="name").awaitTermination()
    assert seen == [(1, "3")]
