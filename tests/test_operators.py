import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rateweave.operators import ranking, scoring, skew
from rateweave.plans import catalog
from tests.conftest import rows


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("a").alias("c")).repartition(5)
    out = ranking.global_row_number(df, [F.desc("x")], "n", start=0)
    assert rows(out, "x", "n") == sorted(((999 - n, n) for n in range(1000)), key=repr)
    assert ranking.global_row_number(df.filter("x < 0"), ["x"]).count() == 0


def test_top_k_per_key_trims_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = ranking.top_k_per_key(df, "k", [F.desc("v")], 2)
    assert rows(out, "k", "v", "rank") == sorted([(k, 4999 - (4999 - k) % 3 - 3 * r, r + 1)
                                                  for k in range(3) for r in range(2)], key=repr)
    plan = df._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1) > plan.index("Exchange")


@pytest.mark.parametrize("a, b, want", [
    ([3, 1, 2], [1, 2, 3], [1, 2, 3]),
    ([5, 1, 9, 2], [2, 1], [None, 2, None, 1]),
    ([4, 4, 7], [7, 4, 7], [4, 4, 7]),  # the last place of 7 counts
    ([8, 9], [], [None, None]),
])
def test_relative_sort_examples(spark, a, b, want):
    schema = "list_id int, pos int, value int"
    left, right = (spark.createDataFrame([(1, p, v) for p, v in enumerate(x)], schema) for x in (a, b))
    assert [v for _, _, v in rows(ranking.relative_sort(left, right), "list_id", "pos", "value")] == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.integers(0, 9), max_size=12), st.lists(st.integers(0, 9), max_size=12)),
                min_size=1, max_size=4))
def test_relative_sort_properties(spark, pairs):
    schema = "list_id int, pos int, value int"
    a = spark.createDataFrame([(l, p, v) for l, (x, _) in enumerate(pairs) for p, v in enumerate(x)], schema)
    b = spark.createDataFrame([(l, p, v) for l, (_, y) in enumerate(pairs) for p, v in enumerate(y)], schema)
    got = {(l, p): v for l, p, v in ranking.relative_sort(a, b).select("list_id", "pos", "value").collect()}
    assert got.keys() == {(l, p) for l, (x, _) in enumerate(pairs) for p in range(len(x))}
    for l, (x, y) in enumerate(pairs):
        out = [got[l, p] for p in range(len(x))]
        assert [v is None for v in out] == [v not in y for v in x]
        kept = [v for v in out if v is not None]
        assert sorted(kept) == sorted(v for v in x if v in y)
        ranks = [len(y) - y[::-1].index(v) for v in kept]
        assert ranks == sorted(ranks)


def skewed(spark, n=3000):
    """A third of the rows under key 1."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).cast("int").alias("k"),
                                 F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_join(spark, how):
    big = skewed(spark).unionAll(spark.sql("select cast(null as int), 1L"))
    unique = spark.range(0, 400).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("w"))
    got = skew.split_join(big, unique, "k", ["v"], how, rows_per_split=100)
    want = big.join(unique, "k", how)
    assert rows(got, *want.columns) == rows(want)


def test_hot_key_is_spread(spark):
    big = skewed(spark)
    hot = skew.hot_keys(big, "k", rows_per_split=100)
    assert rows(hot) == [(1, 10)]
    sizes = [r["count"] for r in skew.with_split(big, "k", hot, ["v"]).groupBy("k", "split").count().collect()]
    assert max(sizes) < 150
    assert skew.hot_keys(big, "k", rows_per_split=2000) is None


def brute_force(users, items, exclude, k, decimals):
    out = []
    for u, x in users.items():
        scored = sorted((-round(float(np.dot(x, y)), decimals) + 0.0, i) for i, y in items.items() if (u, i) not in exclude)
        out += [(u, i, -s + 0.0, r + 1) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def frames(spark, users, items, exclude):
    return (spark.createDataFrame([(u, x) for u, x in users.items()], "user_id int, features array<double>"),
            spark.createDataFrame([(i, y) for i, y in items.items()], "item_id int, features array<float>"),
            spark.createDataFrame(sorted(exclude), "user_id int, item_id int"))


@pytest.mark.parametrize("k", [1, 400])
def test_top_k_scores_equals_brute_force(spark, small_batches, k):
    rng = np.random.default_rng(k)
    # small whole numbers make exact ties common
    users = {u: rng.integers(-2, 3, 3).astype(float).tolist() for u in range(0, 160, 2)}
    items = {i: rng.integers(-2, 3, 3).astype(float).tolist() for i in range(5, 200, 3)}
    # user 0 has excluded almost everything, item 8 is excluded by everybody; some exclusions match nothing
    exclude = {(0, i) for i in items if i > 11} | {(u, 8) for u in users} | {(1, 5), (2, 9999), (4, 6)}
    u, i, e = frames(spark, users, items, exclude)
    got = scoring.top_k_scores(u, i, k, e)
    assert sorted(((u, i, s + 0.0, r) for u, i, s, r in got.collect()), key=repr) == brute_force(users, items, exclude, k, 6)


def test_top_k_scores_does_not_depend_on_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(0)
    users = {u: rng.normal(size=4).tolist() for u in range(200)}
    items = {i: rng.normal(size=4).astype(np.float32).astype(float).tolist() for i in range(300)}
    u, i, e = frames(spark, users, items, {(3, 4)})
    one = rows(scoring.top_k_scores(u, i, 7, e, n_users=1))
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 16 * 4 * 8)
    assert rows(scoring.top_k_scores(u, i, 7, e)) == one
    assert rows(scoring.top_k_scores(u, i, 7, e, n_users=700)) == one
    assert scoring.top_k_scores(u.limit(0), i, 7, e).count() == 0
    assert scoring.top_k_scores(u, i.limit(0), 7, e).count() == 0


def test_a_scan_ends_where_no_score_can_enter_a_list(spark, monkeypatch):
    rng = np.random.default_rng(3)
    users = {u: rng.normal(size=4).tolist() for u in range(40)}
    # a few long vectors among many short ones; some norms are equal
    items = {i: (rng.normal(size=4) * (10 if i % 50 == 7 else 0.1)).round(2).tolist() for i in range(6000)}
    exclude = {(u, i) for u in users for i in range(7, 6000, 50) if (u + i) % 3 == 0} | {(0, i) for i in range(5990)}
    u, i, e = frames(spark, users, items, exclude)
    got = rows(scoring.top_k_scores(u, i, 5, e), "user_id", "item_id", "rank")
    with monkeypatch.context() as patched:
        patched.setattr(scoring, "BLOCK_BYTES", 10 * 4 * 8)
        assert rows(scoring.top_k_scores(u, i, 5, e), "user_id", "item_id", "rank") == got
    out = set(exclude)
    matrix = {i: np.float32(v).astype(float) for i, v in items.items()}
    for user in (0, 1, 17, 39):
        want = sorted(((-sum(float(a) * float(b) for a, b in zip(users[user], v)), i) for i, v in matrix.items() if (user, i) not in out))[:5]
        assert [i for u_, i, _ in sorted(got, key=lambda r: r[2]) if u_ == user] == [i for _, i in want]

    assert sum(n for (n,) in rows(scoring.scan_effort(u, i, 5), "n_items")) == len(items)
    # without the user who has excluded all the long ones, a few slices are enough for all
    effort = scoring.scan_effort(u.filter("user_id > 0"), i, 5, e).agg(
        F.sum("items_scored").alias("items"), F.sum("pairs_scored").alias("pairs")).first()
    # slices double, so some items are scored beyond the last that could enter, but for few users
    assert effort.items < 0.6 * len(items) and effort.pairs < len(items) * 39 / 5


def test_users_without_length_see_every_item(spark):
    u, i, e = frames(spark, {1: [0.0, 0.0], 2: [1.0, 0.0]}, {n: [float(1000 - n), 0.0] for n in range(1000)}, {(1, 0)})
    assert rows(scoring.top_k_scores(u, i, 2, e), "user_id", "item_id", "score", "rank") == [
        (1, 1, 0.0, 1), (1, 2, 0.0, 2), (2, 0, 1000.0, 1), (2, 1, 999.0, 2)]


def test_profile_vectors_and_pairs(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 2.0])], "item_id int, features array<float>")
    picks = spark.createDataFrame([(7, 1, 5.0), (7, 2, 5.0), (7, 3, 5.0), (8, 3, 5.0), (9, 2, 1.0)],
                                  "user_id int, item_id int, rating float")
    profiles = scoring.profile_vectors(picks, items)
    assert rows(profiles) == [(7, [7.5, 10.0]), (9, [0.5, 2.0])]
    predicted = scoring.predict_pairs(picks.select("user_id", "item_id"), profiles, items)
    assert rows(predicted, "user_id", "item_id", "prediction") == [(7, 1, 7.5), (7, 2, 23.75), (9, 2, 4.25)]


def test_scores_are_ranked_unrounded(spark):
    u, i, e = frames(spark, {1: [1.0, 0.0]}, {1: [0.125, 3.0], 2: [0.125, 5.0]}, {(9, 9)})
    near = i.withColumn("features", F.transform("features", lambda x: x.cast("double")))
    near = near.withColumn("features", F.when(F.col("item_id") == 2, F.array(F.lit(0.1250003), F.lit(5.0))).otherwise(F.col("features")))
    assert rows(scoring.top_k_scores(u, near, 1, e), "item_id") == [(2,)]


def test_a_number_costs_one_shuffle_of_the_rows(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("x"))
    plan = ranking.global_row_number(df, ["x"], "n")._jdf.queryExecution().toString()
    assert "row_number" not in plan


def test_the_right_side_of_an_anti_join_is_reduced_first(spark):
    items = spark.range(10).select(F.col("id").cast("int").alias("item_id"))
    ratings = spark.range(90).select((F.col("id") % 7).cast("int").alias("item_id"))
    out = catalog.never_rated(items, ratings)
    assert rows(out) == [(7,), (8,), (9,)]
    assert "HashAggregate" in out._jdf.queryExecution().toString()


def test_a_block_has_room_for_the_users_lists(spark, monkeypatch):
    """Long lists make blocks smaller, and exclusions come to the cells without null arrays."""
    u = spark.createDataFrame([(i, [1.0 + i % 7, 2.0]) for i in range(200)], "user_id bigint, features array<double>")
    i = spark.createDataFrame([(j, [1.0 + j % 5, 1.0]) for j in range(60)], "item_id bigint, features array<double>")
    e = u.select("user_id", (F.col("user_id") % 60).alias("item_id"))
    whole = rows(scoring.top_k_scores(u, i, 48, e))
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 50 * (8 * 2 + 16 * 48))
    cells = scoring.scan_effort(u, i, 48, e).collect()
    assert len({c.cell for c in cells}) >= 4 and max(c.n_users for c in cells) < 100
    assert rows(scoring.top_k_scores(u, i, 48, e)) == whole

    kernel_of = scoring._cell_kernel

    def watched(*how, **more):
        kernel = kernel_of(*how, **more)

        def checked(batches):
            def each():
                for batch in batches:
                    assert batch.column("features").null_count == 0
                    yield batch

            yield from kernel(each())

        return checked

    monkeypatch.setattr(scoring, "_cell_kernel", watched)
    assert rows(scoring.top_k_scores(u, i, 48, e)) == whole


def test_lists_of_many_users_do_not_travel(spark):
    """With enough users for every task a cell sees all items, so its lists are whole and ranked."""
    rng = np.random.default_rng(5)
    users = {u: rng.integers(-3, 4, 3).astype(float).tolist() for u in range(90)}
    items = {i: rng.integers(-3, 4, 3).astype(float).tolist() for i in range(150)}
    exclude = {(u, i) for u in users for i in items if (u + i) % 7 == 0} | {(0, i) for i in items if i > 2}
    u, i, e = frames(spark, users, items, exclude)
    many = scoring.top_k_scores(u, i, 4, e, n_users=10_000_000)
    assert "Window" not in many._jdf.queryExecution().toString()
    assert sorted(((u, i, s + 0.0, r) for u, i, s, r in many.collect()), key=repr) == brute_force(users, items, exclude, 4, 6)
    cells = scoring.scan_effort(u, i, 4, e, n_users=10_000_000).collect()
    assert all(c.n_items == len(items) for c in cells) and sum(c.n_users for c in cells) == len(users)


@pytest.mark.parametrize("length", [1.0, 1e-42, 1e-160, 1e40, 1e150])
def test_lists_are_exact_where_single_precision_is_not(spark, length):
    """Scores that differ in their last bits only, or that single precision cannot hold, keep their order."""
    u = spark.createDataFrame([(n, [length * (1.0 + n), 1.0 * length]) for n in range(20)], "user_id int, features array<double>")
    # of 3,000 items the later ones are better by a part in 2 ** 45
    i = spark.createDataFrame([(n, [1.0 + n * 2.0 ** -45, 1.0]) for n in range(3000)], "item_id int, features array<double>")
    got = scoring.top_k_scores(u, i, 3)
    assert rows(got, "user_id", "rank", "item_id") == sorted(
        ((n, r, 3000 - r) for n in range(20) for r in (1, 2, 3)), key=repr)


def test_equal_scores_behind_a_list_are_not_merged_again():
    """Copies of an item with larger ids lose every tie, so they cost no merging."""
    import pyarrow as pa

    k, n_users, n_items = 4, 50, 40_000

    def batch(phase, kind, ids, vectors):
        n = len(ids)
        ids, no = pa.array(ids, pa.int64()), pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, phase)), pa.array(np.zeros(n)), ids if phase else no, pa.array(np.full(n, kind)),
             no if phase else ids, pa.array(vectors), pa.array(np.zeros(n, np.int32))],
            names=["phase", "norm", "item", "kind", "user", "features", "cell"])

    kernel = scoring._cell_kernel(k)
    merged = []
    lexsort = np.lexsort

    def counted(keys, *how, **more):
        merged.append(keys[0].size)
        return lexsort(keys, *how, **more)

    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(np, "lexsort", counted)
        out = list(kernel(iter([batch(0, 0, range(n_users), [[1.0, 2.0]] * n_users),
                                batch(1, 2, range(n_items), [[2.0, 1.0]] * n_items)])))
    assert [r for o in out for r in zip(*(c.to_pylist() for c in o.columns[:2]))] == [(u, i) for u in range(n_users) for i in range(k)]
    assert sum(merged) < n_users * n_items / 10
