"""What a scan or a batch does not have to read: Bloom filters, hot keys of several columns, growing numbers, keyed state."""

import pytest
from pyspark.sql import functions as F

from rateweave import schemas
from rateweave.operators import skew
from rateweave.operators.membership import may_contain
from rateweave.plans import enrich
from rateweave.plans.factorize import predict_biased
from rateweave.sources.dictionary import grow_dictionary, read_dictionary
from rateweave.streaming import pending
from tests.conftest import rows
from tests.test_streaming import drop
from tests.test_wide_models import plan
from workload import queries


@pytest.mark.parametrize("kind", ["int", "string"])
def test_a_bloom_filter_misses_no_key_and_lets_few_others_pass(spark, kind):
    keys = spark.range(0, 3_000, 3).select(F.col("id").cast(kind).alias("k")).unionAll(spark.sql(f"select cast(null as {kind})"))
    every = spark.range(30_000).select(F.col("id").cast(kind).alias("k"))
    passed = {int(r.k) for r in every.filter(may_contain(keys, "k", F.col("k"))).collect()}
    assert set(range(0, 3_000, 3)) <= passed
    assert len(passed) - 1_000 < 0.05 * 29_000
    full = every.filter(may_contain(keys, "k", F.col("k"), most_words=4))
    assert {int(r.k) for r in full.collect()} >= set(range(0, 3_000, 3))
    assert every.filter(may_contain(keys.limit(0), "k", F.col("k"))).count() == 0
    assert spark.sql(f"select cast(null as {kind}) k").filter(may_contain(keys, "k", F.col("k"))).count() == 0


def above_scan(text):
    """The steps over the file scan, from there to the root."""
    lines = [(len(line) - len(line.lstrip(" :+-*")), line.lstrip(" :+-*")) for line in text.splitlines()]
    at = next(i for i, (_, step) in enumerate(lines) if step.startswith("FileScan parquet"))
    depth, found = lines[at][0], []
    for indent, step in reversed(lines[:at]):
        if indent < depth:
            depth = indent
            found.append(step)
    return found


def test_pages_are_filtered_before_they_move(spark, tmp_path):
    html = '<div class="poster"><img src="u{}"></div>'
    spark.createDataFrame([(i, f"url{i}", html.format(i), 200) for i in range(500)],
                          "item_id int, url string, html string, status int").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    items = spark.createDataFrame([(i, f"l{i}") for i in (3, 7, 900)], "item_id int, link string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = enrich.with_images(items, pages, "item_id")
        text = plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = above_scan(text)
    assert next(step for step in above if step.startswith(("Filter", "Exchange"))).startswith("Filter")
    assert sum("xxhash64" in step for step in above) == 1
    assert rows(found, "item_id", "image_link") == [(3, "u3"), (7, "u7"), (900, None)]


def test_hot_keys_of_two_columns_by_one_pass(spark, monkeypatch):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).cast("int").alias("a"),
                                   F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id") % 7).cast("int").alias("b"))
    found = skew.hot_keys_by(df, ["a", "b"], 100)
    assert rows(found["a"]) == [(1, 10)] and len(rows(found["b"])) == 7  # null is no key
    assert skew.hot_keys_by(df, ["a", "b"], 2_000) == {"a": None, "b": None}
    monkeypatch.setattr(skew, "MOST_HOT_KEYS", 3)
    assert len(rows(skew.hot_keys_by(df, ["b"], 100)["b"])) <= 3


def test_keys_are_counted_in_full_buckets_only(spark, monkeypatch):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).cast("int").alias("a"),
                                   F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id") % 7).cast("int").alias("b"))
    monkeypatch.setattr(skew, "COUNTED_BUCKETS", 2)  # ordinary keys share a bucket with hot ones
    found = skew.hot_keys_by(df, ["a", "b"], 210)
    assert rows(found["a"]) == [(1, 5)]
    assert rows(found["b"], "b") == sorted((r.b,) for r in df.filter("b is not null").groupBy("b").count().filter("count > 210").collect())
    monkeypatch.undo()
    monkeypatch.setattr(skew, "cut_lineage", None)  # without a full bucket no key is counted and nothing written
    assert skew.hot_keys_by(df, ["a", "b"], 2_000) == {"a": None, "b": None}


def test_dense_ratings_join_their_tables_once(spark, tmp_path):
    spark.createDataFrame([(1, 11), (2, 12)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select * from values (1L, 7L, 15.0D, date'1992-01-02'), (2L, 7L, 31.0D, date'1992-01-01'), (2L, 8L, 5.0D, date'1992-01-03') "
              "as t(l_orderkey, l_partkey, l_quantity, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    dense = queries.dense_ratings(spark, str(tmp_path))
    assert rows(dense) == [(0, 0, 4.0), (0, 1, 1.0), (1, 0, 2.0)]
    assert "FileScan" not in spark._jvm.PythonSQLUtils.explainString(dense._jdf.queryExecution(), "simple")


def test_two_hot_columns_change_no_prediction(spark, monkeypatch):
    pairs = spark.range(2_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("int").alias("user_id"),
                                      F.when(F.col("id") % 4 == 0, 2).otherwise(F.col("id") % 40).cast("int").alias("item_id"))
    sides = [spark.range(60).select(F.col("id").cast("int").alias(key), F.array(F.col("id") * 0.5).alias("features"),
                                    (F.col("id") * 1.0).alias("bias")) for key in ("user_id", "item_id")]
    model = type("Model", (), {"users": sides[0], "items": sides[1]})
    want = sorted((r.user_id, r.item_id, r.user_id * r.item_id / 4 + r.user_id + r.item_id) for r in pairs.collect())
    assert rows(predict_biased(pairs, model), "user_id", "item_id", "prediction") == sorted(want, key=repr)
    monkeypatch.setattr(skew, "ROWS_PER_SPLIT", 100)
    by = skew.hot_keys_by
    monkeypatch.setattr("rateweave.plans.factorize.hot_keys_by", lambda df, keys: by(df, keys, 100))
    assert rows(predict_biased(pairs, model), "user_id", "item_id", "prediction") == sorted(want, key=repr)


def test_numbers_stay_and_grow_without_gaps(spark, tmp_path):
    path = str(tmp_path / "dictionary")

    def batch(n, *values):
        df = spark.createDataFrame([(v, t) for t, v in enumerate(values)], "id string, t int")
        return {r.id: r.idx for r in grow_dictionary(df, path, n, "id", ["t"]).collect()}

    assert rows(read_dictionary(spark, path, "string")) == []
    assert batch(1, "c", "a", "c", None) == {"c": 0, "a": 1}
    assert batch(2, "z", "a", "b") == {"c": 0, "a": 1, "z": 2, "b": 3}
    assert batch(3) == {"c": 0, "a": 1, "z": 2, "b": 3}
    assert batch(4, "q", "b", "e") == {"c": 0, "a": 1, "z": 2, "b": 3, "q": 4, "e": 5}
    assert batch(4, "q", "b", "e") == {"c": 0, "a": 1, "z": 2, "b": 3, "q": 4, "e": 5}  # a repeated batch
    assert rows(read_dictionary(spark, path, "string", through=2), "id", "idx", "batch") == [
        ("a", 1, 1), ("b", 3, 2), ("c", 0, 1), ("z", 2, 2)]


def test_a_batch_reads_no_own_history(spark, tmp_path, monkeypatch):
    inbox, read = tmp_path / "in", []
    known = pending.writers.not_yet_processed

    def watched(users, others, run_id):
        read.append(others.count())
        return known(users, others, run_id)

    monkeypatch.setattr(pending.writers, "not_yet_processed", watched)
    done = []

    def job(users):
        done.append(rows(users, "id"))
        return spark.createDataFrame([], schemas.RECOMMENDATIONS)

    def run(progress):
        pending.run_pending(pending.read_selections(spark, str(inbox)), job, str(tmp_path / "r"), str(tmp_path / "l"),
                            str(tmp_path / progress)).awaitTermination()

    for n in range(3):
        drop(inbox, f"{n}.json", [(i, "x", "1,2", None) for i in range(10 * n, 10 * n + 12)])  # two of them are known
        run("one")
    assert [len(d) for d in done] == [12, 10, 10]
    assert read == [0, 0, 0]
    drop(inbox, "4.json", [(500, "x", "1", None), (501, "x", "1", None)])
    run("two")  # a query without a state looks into what the other one marked
    assert done[-1] == [(500,), (501,)]
    assert read[-1] == 32
