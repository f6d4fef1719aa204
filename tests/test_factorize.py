import numpy as np
import pytest
from pyspark.sql import functions as F

from rateweave.operators import least_squares
from rateweave.plans import factorize
from rateweave.plans.catalog import picks_of, with_new_users
from rateweave.plans.recommend import personal_scores, relabel, score_model
from tests.conftest import rows

TOY = np.random.default_rng(21).integers(0, 6, (5, 4)).astype(float)
TOY[[0, 3], [2, 1]] = 0  # no ratings


def toy(spark):
    return spark.createDataFrame([(u, i, float(TOY[u, i])) for u in range(5) for i in range(4)],
                                 "user_id int, item_id int, rating float")


def dense_als(ratings, start, sweeps, ridge):
    """Alternating ridge solves over a list of (user, item, rating), stated per key."""
    rank = len(next(iter(start.values())))
    x, y, errors = {}, dict(start), []

    def solve(mine, other, side):
        out = {}
        for key in {r[side] for r in ratings}:
            seen = [r for r in ratings if r[side] == key]
            design = np.array([other[r[1 - side]] for r in seen])
            out[key] = np.linalg.solve(design.T @ design + ridge * np.eye(rank), design.T @ np.array([r[2] for r in seen]))
        return out

    for _ in range(sweeps):
        x = solve(x, y, 0)
        y = solve(y, x, 1)
        errors.append(sum((r - x[u] @ y[i]) ** 2 for u, i, r in ratings))
    return x, y, errors


def check_model(model, want, tolerance=1e-7):
    x, y, errors = want
    for frame, side in ((model.users, x), (model.items, y)):
        got = {r[0]: r["features"] for r in frame.collect()}
        assert got.keys() == side.keys()
        for key, value in side.items():
            assert got[key] == pytest.approx(list(value), abs=tolerance)
    assert [e for _, e in sorted(model.errors.collect())] == pytest.approx(errors, abs=1e-6)


@pytest.mark.parametrize("rank, widest", [(1, 6), (3, 6), (3, 0)])
def test_weighted_als_equals_dense_solves(spark, rank, widest):
    rng = np.random.default_rng(3)
    start = {i: rng.uniform(0, 5, rank) for i in range(4)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in start.items()], "item_id int, features array<double>")
    model = factorize.weighted_als(toy(spark), rank, 4, 0.2, frame, widest=widest)
    seen = [(u, i, TOY[u, i]) for u in range(5) for i in range(4) if TOY[u, i] > 0.5]
    check_model(model, dense_als(seen, start, 4, 0.2))


def uneven(n_users=40, n_items=30, seed=1):
    """Ratings in which user 0 and item 0 each hold about a third, with repeated pairs."""
    rng = np.random.default_rng(seed)
    out = [(0, int(i), float(r)) for i, r in zip(rng.integers(0, n_items, 300), rng.integers(1, 6, 300))]
    out += [(int(u), 0, float(r)) for u, r in zip(rng.integers(0, n_users, 300), rng.integers(1, 6, 300))]
    out += [(int(u), int(i), float(r)) for u, i, r in
            zip(rng.integers(0, n_users, 300), rng.integers(0, n_items, 300), rng.integers(1, 6, 300))]
    return out


@pytest.mark.parametrize("widest", [6, 0])
def test_hot_keys_and_repeated_pairs_change_nothing(spark, monkeypatch, widest):
    data = uneven()
    ratings = spark.createDataFrame(data, "user_id int, item_id int, rating float")
    start = {i: np.array([1 + i % 3, 0.5]) for i in {i for _, i, _ in data}}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in start.items()], "item_id int, features array<double>")
    lay_out = least_squares.lay_out
    pairs = lay_out(ratings, 10)
    assert pairs.hot["user_id"] is not None and pairs.hot["item_id"] is not None
    assert pairs.by["user_id"].filter("user_id = 0").select("user_id_split").distinct().count() > 1
    monkeypatch.setattr(factorize, "lay_out", lambda r: lay_out(r, 10))
    check_model(factorize.weighted_als(ratings, 2, 2, 0.3, frame, widest=widest), dense_als(data, start, 2, 0.3))


@pytest.mark.parametrize("shuffle_partitions", ["4", "200"])
def test_pairs_are_not_moved_by_a_step(spark, shuffle_partitions):
    pairs = least_squares.lay_out(toy(spark))
    side = spark.range(4).select(F.col("id").cast("int").alias("item_id"), F.array(F.lit(1.0)).alias("design"),
                                 F.lit(0.0).alias("offset"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    try:
        solved = least_squares.solve_side(pairs, "user_id", side, "item_id", [0.1])
        plan = spark._jvm.PythonSQLUtils.explainString(solved._jdf.queryExecution(), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    join = plan.index("SortMergeJoin")
    left = plan[join:plan.index("Scan ExistingRDD", join)]
    assert "Exchange" not in left and "Sort " not in left


def test_arranged_pairs_are_a_row_for_each_key_and_split(spark):
    ratings = spark.createDataFrame(uneven(), "user_id int, item_id int, rating float")
    pairs = least_squares.lay_out(ratings)
    assert pairs.by["user_id"].count() == ratings.select("user_id").distinct().count()
    pairs = least_squares.lay_out(ratings, 10)
    by = pairs.by["item_id"]
    assert by.count() == by.select("item_id", "item_id_split").distinct().count() > ratings.select("item_id").distinct().count()
    met = pairs.meet("item_id", pairs.keys("item_id").withColumn("design", F.array(F.lit(1.0))))
    columns = "user_id", "item_id", "n", "total", "squares"
    assert sorted(map(tuple, met.select(*columns).collect())) == sorted(map(tuple, pairs.rows.select(*columns).collect()))


def test_loss_never_rises(spark):
    ratings = spark.createDataFrame(uneven(seed=5), "user_id int, item_id int, rating float")
    losses = []
    for sweeps in (1, 2, 4):
        model = factorize.weighted_als(ratings, 3, sweeps, 0.4)
        size = sum(sum(v * v for v in r[1]) for frame in (model.users, model.items) for r in frame.collect())
        losses.append(model.errors.filter(F.col("sweep") == sweeps).first()["error"] + 0.4 * size)
    assert all(b <= a + 1e-6 for a, b in zip(losses, losses[1:]))


def test_error_frame_equals_the_joined_error(spark):
    ratings = spark.createDataFrame(uneven(seed=6), "user_id int, item_id int, rating float")
    model = factorize.weighted_als(ratings, 2, 2, 0.4)
    joined = factorize.masked_squared_error(ratings, model).first()
    assert joined["n"] == 900
    assert model.errors.filter("sweep = 2").first()["error"] == pytest.approx(joined["squared_error"])


def test_bias_model_equals_plain_loops(spark):
    data = uneven(seed=7)
    ratings = spark.createDataFrame(data, "user_id int, item_id int, rating float")
    model = factorize.biased_factorization(ratings, 0, 3, 0.1)
    bu, bi = {}, {i: 0.0 for _, i, _ in data}
    for _ in range(3):
        for u in {u for u, _, _ in data}:
            mine = [r - bi[i] for v, i, r in data if v == u]
            bu[u] = sum(mine) / (len(mine) + 0.1)
        for i in bi:
            mine = [r - bu[u] for u, j, r in data if j == i]
            bi[i] = sum(mine) / (len(mine) + 0.1)
    assert {r["user_id"]: r["bias"] for r in model.users.collect()} == pytest.approx(bu)
    assert {r["item_id"]: r["bias"] for r in model.items.collect()} == pytest.approx(bi)


def test_biased_factors_fit_better_than_biases(spark):
    rng = np.random.default_rng(0)
    p, q = rng.normal(size=(30, 2)), rng.normal(size=(25, 2))
    data = [(u, i, float(3 + p[u] @ q[i] + 0.2 * i - 0.1 * u)) for u in range(30) for i in range(25) if (u + i) % 3]
    ratings = spark.createDataFrame(data, "user_id int, item_id int, rating double")
    last = {n: factorize.biased_factorization(ratings, n, 5, 0.05, 0.05) for n in (0, 2)}
    error = {n: m.errors.filter("sweep = 5").first()["error"] for n, m in last.items()}
    assert error[2] < 0.1 * error[0]
    predicted = factorize.squared_error(factorize.predict_biased(ratings, last[2])).first()
    assert predicted["squared_error"] == pytest.approx(error[2], rel=1e-6)
    unseen = spark.createDataFrame([(99, 1, 3.0)], "user_id int, item_id int, rating double")
    assert factorize.predict_biased(unseen, last[2]).count() == 0


def test_rank_items_by_bias_breaks_ties_by_popularity(spark):
    items = spark.createDataFrame([(i, f"t{i}", "A") for i in range(1, 6)], "item_id int, title string, genres string")
    ratings = spark.createDataFrame([(u, i, 3.0) for i in range(1, 6) for u in range(i)], "user_id int, item_id int, rating float")
    biases = spark.createDataFrame([(1, -1.0), (2, 0.5), (3, 0.5), (4, 0.5), (5, 2.0)], "item_id int, bias double")
    model = factorize.FactorModel(None, biases, None)
    out = factorize.rank_items_by_bias(model, ratings, items, most_rated=4, worst=2, best=3)
    assert rows(out, "list", "rank", "item_id", "n_ratings") == [
        ("best", 1, 5, 5), ("best", 2, 4, 4), ("best", 3, 3, 3), ("worst", 1, 4, 4), ("worst", 2, 3, 3)]


def test_holdout_is_repeatable_and_near_the_share(spark):
    ratings = spark.range(5000).select(F.col("id").cast("int").alias("user_id"), (F.col("id") % 7).cast("int").alias("item_id"))
    a = factorize.holdout(ratings, 0.8)
    assert rows(a) == rows(factorize.holdout(ratings.repartition(11), 0.8))
    assert 0.78 < a.filter("is_train").count() / 5000 < 0.82
    assert factorize.holdout(ratings, 0.0).filter("is_train").count() == 0
    assert rows(factorize.holdout(ratings, 0.8, seed=1)) != rows(a)


def clusters(spark):
    """Users below 20 rate items below 15, the others the rest; nobody rates all of their side."""
    data = [(u, i, 5.0) for u in range(40) for i in range(30) if (u < 20) == (i < 15) and (u * 7 + i * 3) % 4]
    return spark.createDataFrame(data, "user_id int, item_id int, rating float")


def test_implicit_als_stays_in_its_cluster_and_repeats(spark):
    pending = spark.createDataFrame([(101, "0,1,2,3,4"), (102, "15,16,17,18,19")], "id int, item_ids string")
    first = rows(personal_scores(pending, clusters(spark), k=6, rank=4), "user_id", "item_id", "rank")
    assert first == rows(personal_scores(pending, clusters(spark), k=6, rank=4), "user_id", "item_id", "rank")
    assert len(first) == 12
    for user, item, _ in first:
        assert (item in range(5, 15)) if user == 101 else (item in range(20, 30))


def test_score_model_ranks_only_eligible_unpicked_items(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id int, features array<float>")
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 7)], "item_id int, features array<float>")
    picks = picks_of(spark.createDataFrame([(1, "6,5")], "id int, item_ids string"))
    eligible = spark.createDataFrame([(i,) for i in (6, 4, 2, 1)], "item_id int")
    scored = score_model(users, items, picks, eligible, 2)
    assert rows(scored) == [(1, 2, 2.0, 2), (1, 4, 4.0, 1)]
    renamed = relabel(scored, spark.createDataFrame([(1, 77)], "user_id int, external_id int"))
    assert {r["user_id"] for r in renamed.collect()} == {77}


def test_model_factors_and_training_types(spark):
    pending = spark.createDataFrame([(101, "0,1,1")], "id int, item_ids string")
    training = with_new_users(clusters(spark), pending)
    assert [f.dataType.simpleString() for f in training.schema] == ["int", "int", "float"]
    assert training.filter("user_id = 101").count() == 3
    model = factorize.implicit_factors(training, rank=3, iterations=2)
    assert model.items.columns == ["item_id", "features"]
    assert model.items.count() == 30
    assert model.users.filter("user_id = 101").count() == 1


def dense_implicit(data, start, iterations, ridge, alpha):
    """Implicit-feedback ALS stated per key over a list of (user, item, rating)."""
    rank = len(next(iter(start.values())))

    def solve(other, side):
        base = sum(np.outer(y, y) for y in other.values())
        out = {}
        for key in {r[side] for r in data}:
            a, b, likes = base.copy(), np.zeros(rank), 0
            for r in (r for r in data if r[side] == key):
                y, c = other[r[1 - side]], alpha * abs(r[2])
                a += c * np.outer(y, y)
                if r[2] > 0:
                    b += (1 + c) * y
                    likes += 1
            out[key] = np.linalg.solve(a + ridge * likes * np.eye(rank), b)
        return out

    y = start
    for _ in range(iterations):
        x = solve(y, 0)
        y = solve(x, 1)
    return x, y


@pytest.mark.parametrize("rows_per_split, widest", [(10, 6), (10, 0), (10**6, 6), (10**6, 0)])
def test_implicit_als_equals_its_equations(spark, monkeypatch, rows_per_split, widest):
    data = [(u, i, r - 1.0) for u, i, r in uneven(seed=8)]  # zero ratings are no likes
    ratings = spark.createDataFrame(data, "user_id int, item_id int, rating float")
    start = {i: np.array([1 + i % 3, 0.5 - i % 2]) for i in {i for _, i, _ in data}}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in start.items()], "item_id int, features array<double>")
    lay_out = least_squares.lay_out
    monkeypatch.setattr(factorize, "lay_out", lambda r, alpha: lay_out(r, rows_per_split, alpha))
    model = factorize.implicit_factors(ratings, 2, 2, 0.1, 0.5, item_start=frame, widest=widest)
    for frame, want in zip((model.users, model.items), dense_implicit(data, start, 2, 0.1, 0.5)):
        got = {r[0]: r["features"] for r in frame.collect()}
        assert got.keys() == want.keys()
        for key, value in want.items():
            assert got[key] == pytest.approx(list(value), abs=1e-8)


def test_personal_lists_follow_the_clusters(spark):
    data = clusters(spark)
    pending = spark.createDataFrame([(101, "0,1,2,3,4"), (102, "15,16,17,18,19")], "id int, item_ids string")
    out = rows(personal_scores(pending, data, k=6, rank=2, iterations=4), "user_id", "item_id")
    assert len(out) == 12
    assert all((item in range(5, 15)) if user == 101 else (item in range(20, 30)) for user, item in out)


def test_pairs_are_not_moved_to_a_side_in_more_partitions(spark, monkeypatch):
    plans, cut = [], factorize.cut_lineage

    def noted(df):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return cut(df)

    monkeypatch.setattr(factorize, "cut_lineage", noted)
    start = toy(spark).select("item_id").distinct().select("item_id", F.array(F.lit(1.0)).alias("features"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        factorize.weighted_als(toy(spark), 1, 2, 0.1, item_start=start)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    joined = [p for p in plans if "SortMergeJoin" in p]
    assert len(joined) == 4 and all(p.count("SortMergeJoin") == 1 for p in joined)  # a step each, of sides that are written
