import pytest
from pyspark.sql import functions as F

from rateweave import schemas
from rateweave.sources import readers, writers
from tests.conftest import rows


def test_csv_with_rejects(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,0\n1,x,3,1\n2,3,,5\n4,5,bad,6\n")
    accepted, rejected = readers.read_ratings_csv(spark, str(tmp_path / "r.csv"))
    assert rows(accepted) == [(1, 2, 3.5, 0), (2, 3, None, 5)]
    assert [f.dataType.simpleString() for f in accepted.schema] == ["int", "int", "float", "bigint"]
    assert rows(rejected, "user_id", "rated_at") == [("1", 1), ("4", 6)]


def test_items_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('movieId,title,genres\n1,"Heat, The (1995)",A|B\n')
    assert rows(readers.read_items_csv(spark, str(tmp_path / "m.csv"))) == [(1, "Heat, The (1995)", "A|B")]


def test_header_mismatch_fails(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,title,genres\n1,a,b\n")
    with pytest.raises(Exception, match="CSV header"):
        readers.read_items_csv(spark, str(tmp_path / "m.csv")).collect()


def test_load_table_casts_by_name(spark):
    df = spark.createDataFrame([("3.5", "7", "9", "z")], "rating string, item_id string, user_id string, other string")
    loaded = readers.load_table(df, parts=3)
    assert rows(loaded) == [(9, 7, 3.5)] and loaded.rdd.getNumPartitions() == 3
    assert readers.load_table(df.drop("rating")).columns == ["item_id", "user_id", "other"]
    with pytest.raises(ValueError, match="missing columns"):
        readers.load_table(df.drop("user_id"))


@pytest.mark.parametrize("low, high, parts", [(1, 100, 7), (5, 5, 4), (-10, 10, 3), (1, 3, 10), (0, 99, 1)])
def test_range_predicates_cover_every_row_once(spark, low, high, parts):
    predicates = readers.range_predicates("c", low, high, parts)
    assert len(predicates) <= parts
    df = spark.range(low - 2, high + 3).select(F.col("id").alias("c")).unionAll(spark.sql("select cast(null as bigint)"))
    hits = df.select(sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates).alias("n"))
    assert hits.distinct().collect() == [(1,)]


def test_factor_round_trip(spark, tmp_path):
    factors = spark.createDataFrame([(1, [0.5, 1.25]), (2, [3.0, -1.0])], schemas.ITEM_FACTORS)
    writers.export_item_factors(factors, str(tmp_path / "f"))
    assert rows(readers.read_item_factors(spark, str(tmp_path / "f"))) == [(1, [0.5, 1.25]), (2, [3.0, -1.0])]


def test_runs_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "recs")
    assert writers.read_runs(spark, path, schemas.RECOMMENDATIONS).count() == 0
    df = spark.createDataFrame([(1, 2, 0.5, "l", 1)], "user_id int, item_id int, prediction double, link string, rank int")
    for _ in range(2):
        writers.write_recommendations(df, path, "a")
    writers.write_recommendations(df, path, "b")
    stored = writers.read_runs(spark, path, schemas.RECOMMENDATIONS)
    assert rows(stored) == [(1, 2, 0.5, "l", None, 1, "a"), (1, 2, 0.5, "l", None, 1, "b")]
    assert len(schemas.RECOMMENDATIONS) == 6
    with pytest.raises(ValueError):
        writers.write_run(df, path, "a/b")


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    users = spark.createDataFrame([(1,), (2,)], "id int")
    writers.mark_processed(users.filter("id = 1"), path, "r1")
    ledger = writers.processed_users(spark, path)
    assert rows(writers.not_yet_processed(users, ledger, "r2")) == [(2,)]
    assert rows(writers.not_yet_processed(users, ledger, "r1")) == [(1,), (2,)]


def test_write_picks(spark):
    users = spark.createDataFrame([(1, "5"), (2, None)], "id int, item_ids string")
    picks = spark.createDataFrame([(2, "7,8")], "user_id int, item_ids string")
    assert rows(writers.write_picks(users, picks)) == [(1, "5"), (2, "7,8")]
