"""Ratings in bucketed tables."""

import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rateweave.plans import explore
from rateweave.sources import stored


@pytest.fixture(scope="module")
def ratings(spark):
    """Item 1 holds a third of the rows, user 7 a tenth; some ids and ratings are null, some pairs come twice."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, 7).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 83).cast("int").alias("user_id"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 89 == 0, None).otherwise(F.col("id") % 41).cast("int").alias("item_id"),
        F.when(F.col("id") % 53 != 0, F.col("id") % 5 + 1).cast("float").alias("rating"))
    return df.unionAll(df.limit(20))


@pytest.fixture(scope="module")
def kept(spark, ratings, tmp_path_factory):
    return stored.store_ratings(ratings, f"r_{uuid.uuid4().hex}", str(tmp_path_factory.mktemp("stored")), buckets=6, rows_per_split=100)


def exchanges_above(df, key):
    """Whether the plan moves rows of the table stored by ``key``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    depth = [(len(line) - len(line.lstrip(" :+-*()0123456789")), line) for line in plan.splitlines()]
    scan = next(i for i, (_, line) in enumerate(depth) if "FileScan" in line and f"by_{key}" in line)
    at, above = depth[scan][0], []
    for d, line in reversed(depth[:scan]):
        if d < at:
            at = d
            above.append(line)
    return [line for line in above if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("key", ["user_id", "item_id"])
def test_both_tables_hold_every_rating_and_split_hot_keys(spark, ratings, kept, key):
    assert rows(kept.table(key), *ratings.columns) == rows(ratings)
    assert kept.hot(key).filter(F.col(key) == (7 if key == "user_id" else 1)).count() == 1
    sizes = [r["count"] for r in kept.table(key).groupBy(key, "split").count().collect()]
    assert max(sizes) < 400 if key == "item_id" else max(sizes) < 300


@pytest.mark.parametrize("key", ["user_id", "item_id"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_join_moves_no_rating(spark, ratings, kept, key, how):
    unique = spark.range(0, 30).select(F.col("id").cast("int").alias(key), (F.col("id") * 2).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = kept.join(unique, key, how)
        assert rows(got, *sorted(got.columns)) == rows(ratings.join(unique, key, how), *sorted(got.columns))
        assert not exchanges_above(got, key.removesuffix("_id"))
        plain = ratings.join(unique, key, how)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" in plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sums_and_pairs(spark, ratings, kept):
    assert rows(kept.sums("item_id"), "item_id", "n", "total") == rows(explore.item_sums(ratings), "item_id", "n", "total")
    pairs = kept.pairs("user_id")
    whole = ratings.dropna(subset=["user_id", "item_id", "rating"])
    assert rows(pairs) == rows(whole.groupBy("user_id", "item_id").agg(F.count("rating"), F.sum(F.col("rating").cast("double"))))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_another_session_opens_them(spark, ratings, kept, tmp_path):
    again = stored.open_ratings(spark.newSession(), f"again_{uuid.uuid4().hex}", kept.folder)
    assert rows(again.table("user_id"), *ratings.columns) == rows(ratings)
    assert "Exchange" not in again.pairs("item_id")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        stored.open_ratings(spark, "nothing", str(tmp_path))


def test_no_ratings(spark, ratings, tmp_path):
    empty = stored.store_ratings(ratings.limit(0), f"e_{uuid.uuid4().hex}", str(tmp_path / "e"), buckets=2)
    assert empty.sums("user_id").count() == 0 and empty.table("item_id").count() == 0


def test_buckets_grow_with_the_ratings(spark, ratings, tmp_path, monkeypatch):
    """A task sums one bucket's pairs, so a bucket has a bounded number of ratings."""
    assert stored.ROWS_PER_BUCKET <= 1_000_000
    monkeypatch.setattr(stored, "ROWS_PER_BUCKET", 100)
    name = f"g_{uuid.uuid4().hex}"
    stored.store_ratings(ratings, name, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/manifest").first().buckets == -(-ratings.count() // 100)
